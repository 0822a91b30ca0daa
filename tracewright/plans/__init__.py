"""tracewright.plans"""
