"""Tables, web pages, text and conversation logs as Spark DataFrames.

Sub-packages: ``sources`` (scans and sinks), ``functions`` (column expressions and
the few Arrow functions), ``operators`` (DataFrame -> DataFrame), ``plans`` (SQL
passage and the registered queries), ``streaming`` (incremental twins).
"""

from tabledoc.session import build_session, load_table, scratch_dir

__all__ = ["build_session", "load_table", "scratch_dir"]
