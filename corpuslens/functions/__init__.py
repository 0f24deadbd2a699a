"""corpuslens.functions"""
