"""corpusframe.sources"""
