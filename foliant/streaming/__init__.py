"""foliant.streaming"""
