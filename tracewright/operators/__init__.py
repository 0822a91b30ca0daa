"""tracewright.operators"""
