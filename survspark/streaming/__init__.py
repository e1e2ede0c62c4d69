"""Streaming: intentionally empty.

The reference pipeline processes no streams (no watermarks, windows, state or late-data rules),
so there is nothing to re-express with Structured Streaming here.  Every operator in
``survspark.operators`` is a batch DataFrame transformation.
"""
