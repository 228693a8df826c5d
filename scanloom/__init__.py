"""Spark analytics for collections of annotated 3D scans."""
