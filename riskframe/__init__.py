"""riskframe: entity-level risk tables on Spark.

Every operator takes DataFrames (plus column names / an ``EngineSpec``)
and returns DataFrames.  No operator triggers an action unless its
docstring says so (model fitting, which is an action by nature).
"""

from riskframe.spec import EngineSpec, tpch_binding

__all__ = ["EngineSpec", "tpch_binding"]
