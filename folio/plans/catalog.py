"""Imports every module of core queries, which fills the registry."""

from folio.plans import archive, cards, drafting, matching, parsing, quality, references, rules, streams, texts  # noqa: F401
