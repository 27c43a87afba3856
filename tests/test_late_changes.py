import pytest

from lakekit.errors import ValidationError
from lakekit.streaming.apply import ChangeApplier

from .conftest import rows
from .test_problems import CHANGES, feed, machine


def test_late_partial_changes_are_applied_to_older_columns(spark, tmp_path):
    data = [(k + 10 * s if k else k, *r) for s in range(4) for k, *r in feed(s, 30)]
    data += [(90, 1, "a", "insert", 1), (90, None, "b", "update_postimage", 6), (90, 9, None, "update_postimage", 5), (91, 3, None, "update_postimage", 4), (91, None, None, "delete", 2)]
    data += [(92, 1, None, "update_postimage", 3), (92, 7, "i", "insert", 2), (93, 1, "a", "insert", 1), (93, 2, None, "update_postimage", 8), (93, None, None, "delete", 5)]
    a = ChangeApplier(spark, str(tmp_path / "t"), ["k"], "seq", "op", ["x", "y"], partial=True)
    for i in range(3):  # neighbours in different batches
        a.apply(spark.createDataFrame(data[i::3], CHANGES))
    got = rows(a.records().select("k", "x", "y", "seq"))
    assert got == machine(data, True)
    assert (90, 9, "b", 6) in got and (91, 3, None, 4) in got and (92, 1, "i", 3) in got and (93, 2, None, 8) in got
    a.apply(spark.createDataFrame(data[1::3], CHANGES))  # the same once more
    assert rows(a.records().select("k", "x", "y", "seq")) == got
    with pytest.raises(ValidationError):
        ChangeApplier(spark, str(tmp_path / "t"), ["k"], "seq", "op", ["x", "y"]).apply(spark.createDataFrame(data, CHANGES))
