"""All registered queries; importing this module registers them."""

from .plans import corpus, evaluation, packages, streaming, text  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
