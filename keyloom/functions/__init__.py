"""Key rules, key-range columns and errors."""

from .errors import *  # noqa: F403
from .keys import KeyPath, KeyPrefix, after, in_prefix, key_length, rollup_path, successor

__all__ = ["KeyPath", "KeyPrefix", "after", "in_prefix", "key_length", "rollup_path", "successor"]
