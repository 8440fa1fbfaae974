"""vinolake.sources"""
