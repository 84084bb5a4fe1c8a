"""Imports every catalog module so their ``register`` calls populate ``REGISTRY``."""
from . import q_chain, q_enrich, q_graph, q_models, q_profile, q_sketches, q_splits, q_stream  # noqa: F401
from .registry import REGISTRY  # noqa: F401
