"""tracewright"""
