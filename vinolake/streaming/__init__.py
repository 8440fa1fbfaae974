"""vinolake.streaming"""
