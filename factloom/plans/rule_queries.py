"""Rules over an inline repository, registered so that the driver can run them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .audit import audit
from .catalogue import query

FILES = [
    ("shop/api.py", "from typing import Any\n\n\ndef load(cfg: Any, extra=[]):\n    return cfg\n\n\ndef is_open(a) -> int:\n    return a\n"),
    ("shop/a.py", "import shop.b\n\n\ndef wide(a, b, c, d, e):\n    for i in range(len(a)):\n        print(a[i], b, c, d, e)\n"),
    ("shop/b.py", "import shop.a\n\n\ndef lonely():  # factloom allow: dead-symbols\n    return getattr(lonely, 'x' + 'y')\n"),
    ("shop/__init__.py", ""),
    ("tests/test_a.py", "import time\n\n\ndef test_sleep():\n    time.sleep(2)\n\n\ndef test_same():\n    assert 1 == 1\n"),
]


@query("audit_inline")
def audit_inline(spark, sf):
    files = spark.createDataFrame(FILES, "rel string, text string")
    precision = spark.createDataFrame([("49", 44, 46), ("35", 5, 5), ("12", 66, 80)], "rule string, tp long, n long")
    # the rules that this small repository can set off; Spark takes long to compile all
    out = audit(files, precision=precision, only=[1, 12, 24, 32, 35, 40, 44, 47, 49, 50, 55]).ranked
    return out.select("rule", "slug", "rel", "line", "symbol", "message", F.round("p_real", 6).alias("p_real"), "within")
