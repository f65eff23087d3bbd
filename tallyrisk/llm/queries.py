"""Imports every operator of this folder, so that its queries are listed."""

from tallyrisk.llm import (decontaminate, hosts, licences, mixing, neardup, neighbours, personal, quality, ranked, secrets,  # noqa: F401
                           spelling, suffix_tree, toxicity)  # noqa: F401
from tallyrisk.llm.common import ORACLES, QUERIES  # noqa: F401
