"""quern.registry"""
