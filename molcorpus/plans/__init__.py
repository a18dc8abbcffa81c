"""All registered queries; importing a module registers its queries."""

from molcorpus.plans import (  # noqa: F401
    detection,
    tokenization,
    vocabulary,
    encoding,
    mixing,
    instruction,
    evaluation,
    embedding,
    training,
    files,
)
from molcorpus.plans.registry import ORACLES, QUERIES  # noqa: F401
