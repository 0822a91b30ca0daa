"""tracewright.functions"""
