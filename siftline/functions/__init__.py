"""Column builders: pure Spark SQL expressions, usable in batch and in streams."""

from siftline.functions.contact import *  # noqa: F401,F403
from siftline.functions.dates import *  # noqa: F401,F403
from siftline.functions.extract import *  # noqa: F401,F403
from siftline.functions.labels import *  # noqa: F401,F403
from siftline.functions.numbers import *  # noqa: F401,F403
from siftline.functions.text import *  # noqa: F401,F403
