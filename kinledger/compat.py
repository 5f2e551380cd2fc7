"""Switches for literal behaviours that differ from the documented intent, all off by default."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Compat:
    """legacy_or: an operator joins its filter to the next one, without brackets around the scope.
    legacy_text_sort: fields other than the times sort as text. legacy_like: ``%`` and ``_`` in
    a searched text are wildcards. legacy_nil_scope: the scope of all owners leaves out
    objects of the nil owner. legacy_holdings: a holding counts burned value when it is asked
    whether it is empty."""

    legacy_or: bool = False
    legacy_text_sort: bool = False
    legacy_like: bool = False
    legacy_nil_scope: bool = False
    legacy_holdings: bool = False


DEFAULT = Compat()
