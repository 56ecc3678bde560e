"""Operators of the dialect; importing this package registers them."""

from . import basic, events, expansion, joins, running, sessions  # noqa: F401
