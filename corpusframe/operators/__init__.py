"""corpusframe.operators"""
