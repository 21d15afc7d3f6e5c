"""Intentionally empty: the credit-risk workload is batch only.

The feature builders are stateless projections, so they accept a streaming
DataFrame unchanged; nothing here needs watermarks or state.
"""
