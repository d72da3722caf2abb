"""What a search measures for a query grows far slower than the table."""

from obsframe.llm import neighbours as N


def test_work_of_a_query_grows_slower_than_the_table():
    work = lambda nodes: N.beam_of(nodes) * N.degree_of(nodes)
    assert work(10_000) < work(51_282) < 2 * work(10_000)
    assert work(640_000) < 3 * work(10_000)
