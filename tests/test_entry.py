"""The driver contract of __spark_entry__.py."""

import importlib.util
import os


def _entry_module():
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry_under_test", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_contract(spark):
    m = _entry_module()
    df1, df2 = m.entry(spark), m.entry(spark)
    assert df1.schema == df2.schema
    assert [f.name for f in df1.schema.fields] == ["cwe", "severity_bucket", "n_findings"]
    assert df1.count() > 0
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 56
    assert all(callable(f) for f in q.values()) and all(isinstance(s, str) and s for s in o.values())
