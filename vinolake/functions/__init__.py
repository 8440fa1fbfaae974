"""vinolake.functions"""
