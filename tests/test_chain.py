"""Places of pages in their chains against walking along them."""

import random

import pytest

from tenderlens.sources import chain


def walked(links):
    out = {}
    for start in links:
        seen, at = [start], start
        while True:
            after = links[at]
            if after is None or after not in links:
                out[start] = (len(seen) - 1, at, "last" if after is None else "missing", False)
                break
            if after in seen:
                ring = seen[seen.index(after):]
                out[start] = (None, min(ring), "cycle", start in ring)
                break
            seen.append(after)
            at = after
    return out


def ranked(spark, links):
    rows = chain.rank_links(spark.createDataFrame(list(links.items()), "node string, next string")).collect()
    return {r.node: (r.steps, r.end, r.ends_in, r.on_cycle) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_links(spark, seed):
    rng = random.Random(seed)
    names = [f"p{i:03d}" for i in range(90)]
    links = {n: rng.choice([None, "absent", *names, *names, names[(i + 1) % 90], names[(i + 1) % 90]]) for i, n in enumerate(names)}
    assert ranked(spark, links) == walked(links)


def test_shapes(spark):
    line = {f"a{i:03d}": f"a{i + 1:03d}" for i in range(100)} | {"a100": None}
    ring = {f"r{i}": f"r{(i + 1) % 7}" for i in range(7)} | {"t0": "t1", "t1": "r3"}
    hub = {f"h{i}": "a050" for i in range(40)}
    alone = {"self": "self", "one": None, "gap": "nowhere"}
    links = line | ring | hub | alone
    assert ranked(spark, links) == walked(links)
    assert ranked(spark, {}) == {}


def test_pages(spark):
    feed = lambda *links: '<feed xmlns="http://www.w3.org/2005/Atom">' + "".join(links) + "</feed>"
    named = lambda n: f'<link rel="next" href="{n}"/>'
    pages = spark.createDataFrame([
        ("http://x/1.atom", feed(named("2.atom?x=1"))), ("http://x/2.atom", feed(named("3.atom"))), ("http://x/3.atom", feed()),
        ("http://x/0.atom", feed(named("http://x/2.atom"))), ("http://y/1.atom", feed(named("2.atom")))], "source_file string, value string")
    got = {r.page: r for r in chain.feed_chain_rank(pages).collect()}
    assert {p: (r.chain[-8:], r.position, r.pages_after, r.ends_in, r.n_named_by) for p, r in got.items()} == {
        "http://x/1.atom": ("x/3.atom", 1, 2, "last", 0), "http://x/0.atom": ("x/3.atom", 1, 2, "last", 0),
        "http://x/2.atom": ("x/3.atom", 2, 1, "last", 2), "http://x/3.atom": ("x/3.atom", 3, 0, "last", 1),
        "http://y/1.atom": ("y/1.atom", 1, 0, "missing", 0)}
    assert {(r.chain[-8:], r.n_pages, r.n_beginnings, r.n_forks, r.is_complete) for r in chain.feed_chains(chain.feed_chain_rank(pages)).collect()} == {
        ("x/3.atom", 4, 2, 1, False), ("y/1.atom", 1, 1, 0, False)}
    whole = chain.feed_chains(chain.feed_chain_rank(pages.where("source_file LIKE '%x/_.atom' AND source_file NOT LIKE '%0.atom'"))).collect()
    assert [(r.n_pages, r.is_complete) for r in whole] == [(3, True)]
