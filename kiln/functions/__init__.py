"""Column-level scalar expressions. Every function returns a Column built
from pyspark.sql.functions, so it stays inside whole-stage codegen."""

from kiln.functions.strings import *  # noqa: F401,F403
from kiln.functions.net import *  # noqa: F401,F403
from kiln.functions.timefn import *  # noqa: F401,F403
from kiln.functions.hashing import *  # noqa: F401,F403
