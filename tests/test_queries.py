import pytest

from tests.conftest import DATA
from tests.oracle import connect, duck_rows, spark_rows
from turnstone import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con():
    return connect(f"{DATA}/sf0.01")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_those_of_the_sql(spark, con, name):
    assert spark_rows(QUERIES[name](spark, f"{DATA}/sf0.01")) == duck_rows(con, ORACLES[name])


def test_every_query_has_sql_but_the_model():
    assert set(QUERIES) - set(ORACLES) == {"M01_tfidf_logreg"}


def test_linear_baseline_learns(spark):
    r = QUERIES["M01_tfidf_logreg"](spark, f"{DATA}/sf0.01").toPandas()
    assert (r["label"] == r["prediction"]).mean() > 0.9


def test_budget_stops_at_whole_turns(spark):
    from turnstone.operators import contexts

    rows = [(1, 0, "user", "a", "dev", 3, 1), (1, 1, "assistant", "b", "dev", 4, 1), (1, 2, "user", "c", "dev", 2, 1), (1, 4, "user", "d", "dev", 50, 1)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, split string, words long, bit int")
    got = {(r.conv_id, r.turn): (r.kept, r.dropped, r.context_words) for r in contexts.budgeted(t, 7).collect()}
    assert got == {(1, 0): (0, 0, 0), (1, 2): (1, 1, 5), (1, 4): (0, 3, 0)}  # equal fits; a target over the budget has no context


def test_donors_of_few_dialogues(spark):
    """Dialogues without a domain, whose own class is among their candidates', and classes of one."""
    from turnstone.operators import contexts

    bits = {1: (0, 0, 0), 2: (0, 0, 0), 3: (1, 0, 2), 4: (2, 2, 2), 5: (4, 1, 1), 6: (0, 0, 0)}
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", f"t{c}{k}", "dev" if c < 6 else "test", 1, b) for c, own in bits.items() for k, b in enumerate(own)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, split string, words long, bit int")
    may = {c: sorted(d for d, x in bits.items() if d != c and (d < 6) == (c < 6) and not (x[0] | x[1]) & (own[0] | own[1] | own[2])) for c, own in bits.items()}
    got = {r.conv_id: r for r in contexts.donors(t).collect()}
    assert set(got) == set(bits)
    for c, r in got.items():
        assert r.n_candidates == len(may[c]) and (r.donor in may[c] if may[c] else r.donor is None), c
    chosen = {contexts.donors(t, seed).where("conv_id = 4").first().donor for seed in range(30)}
    assert chosen == set(may[4])
