import pytest

from weftgraph.plans import playback, scenes, trade

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("make", [trade.trade, scenes.dataset, trade.distances, playback._networks])
def test_lineitem_is_joined_once(spark, make):
    for part in make(spark, SF):
        assert "l_orderkey" not in part._jdf.queryExecution().optimizedPlan().toString()


def test_flows_are_the_same_without_broadcast(spark, monkeypatch):
    rows = lambda: {(r.step, r.i, r.j): r.w for r in trade.trade(spark, SF)[0].collect()}
    found = rows()
    monkeypatch.setattr(trade, "BROADCAST_ROWS", 0)
    assert len(found) > 1000 and rows() == pytest.approx(found)
