"""Every order line of the test tables either trains or is scored."""

import os

import pytest

from starcast.checks import views


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
def test_all_order_lines_are_used(spark, scale):
    folder = f"/root/testdata/sf{scale}"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    raw, trained, held_out = (f(spark, folder) for f in (views.raw_ratings, views.ratings, views.held_out))
    assert trained.count() + held_out.count() == raw.count()
    assert trained.exceptAll(raw).count() == held_out.exceptAll(raw).count() == 0
    scored = views.pairs(spark, folder).join(held_out, ["user_id", "business_id"])
    assert scored.count() == held_out.count()
