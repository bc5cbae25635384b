"""Helpers the operators share."""

from spreadlake.llm import common


def test_a_worker_gives_back_what_it_held():
    built = []
    first = common.held("model", lambda: built.append(1) or object())
    assert common.held("model", lambda: built.append(1) or object()) is first
    common.give_back()
    assert not common._HELD
    assert common.held("model", lambda: built.append(1) or object()) is not first
    assert len(built) == 2
    common.give_back()
