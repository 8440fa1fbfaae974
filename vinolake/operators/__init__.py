"""vinolake.operators"""
