"""corpuslens.sources"""
