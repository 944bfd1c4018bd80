"""corpusframe.plans"""
