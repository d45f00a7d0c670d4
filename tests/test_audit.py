from datetime import datetime

import pytest

from tidemark.operators import audit

TEXT = """# Plan
```toml
strategy_id = "s"
strategy_class = "DAILY_TREND"
timeframe = "D"
hypothesis = "h"
cells = [1, 2]
created_at = 2024-01-01
[thresholds]
ci = 0.0
```
"""


def test_preregistration():
    table = audit.preregistration(TEXT)
    assert audit.registration_hash(table) == audit.registration_hash(audit.preregistration(TEXT.replace("created_at = 2024-01-01", "created_at = 2025-01-01")))
    assert audit.registration_hash(table) != audit.registration_hash(table | {"hypothesis": "other"})
    with pytest.raises(ValueError):
        audit.preregistration(TEXT.replace('timeframe = "D"', ""))
    with pytest.raises(ValueError):
        audit.preregistration("nothing")


def test_ordering():
    a, b = datetime(2024, 1, 1), datetime(2024, 1, 2)
    assert audit.ordering_faults(a, b, False, "x", "x") == []
    assert len(audit.ordering_faults(b, a, True, "x", "y")) == 3
    assert audit.ordering_faults(None, a, False, "x", "x") == ["missing timestamp"]


def test_ledger(spark):
    rows = spark.createDataFrame([("a", "live", 1.0, 2), ("b", "paper", 0.5, 1)], audit.LEDGER)
    s = audit.ledger_summary(audit.checked_ledger(rows)).first()
    assert (s["n_trials"], s["n_cells"], s["shadow_ids"], s["live_ids"]) == (2, 3, ["b"], ["a"])
    with pytest.raises(ValueError):
        audit.checked_ledger(rows.union(rows))
    with pytest.raises(ValueError):
        audit.checked_ledger(spark.createDataFrame([("a", "other", 1.0, 2)], audit.LEDGER))
    table = audit.lessons(spark)
    assert table.count() == 15 and audit.unenforced_lessons(table).count() == 0
    assert audit.enforcement_for(table, "L65").first()["enforced_by"] == "test" and audit.enforcement_for(table, "X").count() == 0
    assert {r["lesson"] for r in audit.lessons_by_mechanism(table, "reviewer").collect()} == {"L74", "L75", "L76"}
