"""corpuslens.streaming"""
