"""pagelake: Spark jobs over a table of stored web/forum pages.

Every operator is a DataFrame -> DataFrame function built from built-in
Spark SQL expressions, joins, aggregates and windows.  Nothing here fetches
from the network; the input is a table of already stored pages.
"""

__version__ = "0.1.0"
