import pytest

from squallframe.llm import queries

from ..compare import connect, same


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


def texts(con):
    return dict(con.execute("select doc_id, text from documents").fetchall())


def ids(g, con):
    from squallframe.llm import tokens

    c = tokens.Codec(tokens.model_bytes(tokens.read_ranks(f"{tokens.TOKENIZER_DIR}/{tokens.VOCABULARY}")))
    have = texts(con)
    assert set(g.doc_id) == set(have) and g.doc_id.is_unique
    assert all(c.decode(i) == (have[d] or "") for d, i in zip(g.doc_id, g.ids))


def short(g, con):
    assert not g.duplicated(["mix_id", "source"]).any()  # equal to brute force below


def mix(g, con):
    most = {(m, "".join(x for x in s.lower() if x.isalnum())): u for m, s, u in con.execute("select mix_id, source, max(max_uses) from mix_targets where source is not null group by all").fetchall()}
    assert not g.duplicated(["mix_id", "doc_id"]).any() and (g.uses >= 1).all() and all(u <= most[m, c] for m, c, u in zip(g.mix_id, g.category, g.uses))


def shares(g, con):
    assert len(g) == con.execute("select count(*) from mix_targets").fetchone()[0] and (g.tokens <= g.capacity.clip(lower=g.tokens)).all()
    good = g[~g.short & (g.want > 20_000)]
    assert ((good.tokens - good.want).abs() <= 0.05 * good.want).all()
    sums = g.groupby("mix_id").share.sum()
    assert ((sums - 1).abs() < 1e-9).all() and (g.steps > 1).all()


def loose(g, con):
    assert (g.steps > 1).all() and ((g.groupby("mix_id").share.sum() - 1).abs() < 1e-9).all()


def damaged(g, con):
    have = texts(con)
    assert g.doc_id.is_unique and set(g.doc_id) <= set(have) and 0 < len(g) < 0.2 * len(have)


def restored(g, con):
    have = texts(con)
    assert all(r is None or r != have[d] for d, r in zip(g.doc_id, g.restored)) and g[g.restored.isna()].kind.eq("lost").all()


# What holds for the results that no SQL can check.
CHECKS = {"p6_ids": ids, "p7_found": short, "p7_loose_shares": loose, "p7_mix": mix, "p7_shares": shares, "p8_found": damaged, "p8_restored": restored}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, con, name):
    got = queries.QUERIES[name](spark, data)
    if name in queries.SQL:
        same(got, con, queries.SQL[name])
    else:
        CHECKS[name](got.toPandas(), con)


def test_short_sources_by_brute_force(spark, data, con):
    import collections

    from squallframe.llm import tokens

    c = tokens.codec(tokens.load_model(spark).value)
    key = lambda s: "".join(x for x in s.lower() if x.isalnum())
    held = collections.Counter()
    for text, source in con.execute("select text, source from documents where source is not null").fetchall():
        held[key(source)] += len(c.encode(text))
    want = {(m, s) for m, total, s, w, uses in con.execute("select mix_id, total_tokens, source, weight, max_uses from mix_targets").fetchall() if held[key(s)] * uses < w * total}
    assert {tuple(r) for r in queries.QUERIES["p7_found"](spark, data).collect()} == want
