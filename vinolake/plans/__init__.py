"""vinolake.plans"""
