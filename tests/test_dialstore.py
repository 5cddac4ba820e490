import pytest

from kithgraph.plans import dials as D
from kithgraph.plans.dialstore import DialStore


def test_changes_of_users(spark, tmp_path):
    kept = DialStore(spark, f"{tmp_path}/dials", 4)
    assert kept.get(7) is None and kept.get_or_default(7) == D.Dials() and kept.count() == 0 and not kept.delete(7)
    first, second = D.Dials(tau=7200.0, explore=0.2), D.Dials(min_likes=9)
    kept.set(7, first), kept.set(8, first), kept.set(7, second)
    with pytest.raises(ValueError):
        kept.set(7, D.Dials(explore=0.9))
    assert kept.get(7) == second and kept.get(8) == first and kept.count() == 2
    assert kept.delete(8) and kept.get(8) is None and kept.count() == 1 and not kept.delete(8)
    assert kept.compact() and kept.rows().count() == 1 and kept.get(7) == second
    kept.set(8, second)
    assert {r["user_id"] for r in kept.saved().collect()} == {7, 8}
    kept.clear()
    assert kept.count() == 0 and kept.get(7) is None
