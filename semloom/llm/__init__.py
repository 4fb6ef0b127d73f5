"""Operators for preparing training text at corpus scale.

Nothing outside this folder imports it; it may be removed without touching the engine.
"""
