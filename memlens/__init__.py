"""memlens: a PySpark engine for stores of agent memories.

Every operator is a pure function from DataFrames to a DataFrame. Importing the
package starts no session.
"""

__version__ = "0.1.0"
