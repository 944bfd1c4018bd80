"""corpusframe.streaming"""
