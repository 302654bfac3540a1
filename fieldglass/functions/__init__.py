"""Column functions: text and names, numbers and casts, JSON documents, windows."""

from .columns import *  # noqa: F403
from .windows import *  # noqa: F403
