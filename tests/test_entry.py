import importlib.util
import os

from conftest import ROOT


def test_entry_smoke(spark):
    spec = importlib.util.spec_from_file_location("entry_mod", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.count() == 1394
    assert df.agg({"flag": "sum"}).first()[0] == 92
    assert len(mod.queries()) >= 90 and set(mod.oracle_sql()) <= set(mod.queries())
