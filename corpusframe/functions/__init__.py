"""corpusframe.functions"""
