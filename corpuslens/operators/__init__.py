"""corpuslens.operators"""
