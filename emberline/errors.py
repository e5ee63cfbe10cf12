"""Classed conditions: each guard has its own type so that callers can react."""

from __future__ import annotations

import warnings


class EmberError(ValueError):
    """Base class of every refusal."""


class GridMismatch(EmberError):
    """Two layers do not share a grid; only the aligner may change one."""


class ResolutionTooCoarse(EmberError):
    """The cell is wider than a third of the radius."""


class WindowTooLarge(EmberError):
    """The window does not fit the layer."""


class AllNull(EmberError):
    """A layer holds no value at all."""


class BadRange(EmberError):
    """A layer is constant, negative or outside the accepted range."""


class BadLookup(EmberError):
    """A lookup table breaks its contract."""


class BadWeights(EmberError):
    """Weights are unknown, negative or do not add up."""


class BadWeather(EmberError):
    """A weather table lacks columns or holds impossible values."""


class BadPeriod(EmberError):
    """A period or season cannot be read."""


class EmptyReference(EmberError):
    """No record falls inside the reference period and season."""


class EmptyResult(EmberError):
    """A selection left nothing to work on."""


class DegenerateSample(EmberError):
    """A validation sample holds one class only."""


class VintageRequired(EmberError):
    """A temporal filter needs a fuel vintage that is unknown."""


class RoleRefused(EmberError):
    """A layer has a role the operator must not accept."""


class ParetoTooLarge(EmberError):
    """Too many distinct combinations for a dominance scan."""


class UnknownName(EmberError):
    """A named metric, layer, class or date does not exist."""


class EmberWarning(UserWarning):
    """Base class of every notice."""


def notice(message: str, category: type[Warning] = EmberWarning) -> None:
    """Warn once per session and message, as Python's registry does."""
    warnings.warn(message, category, stacklevel=3)
