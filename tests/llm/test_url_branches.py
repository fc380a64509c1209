"""Labels of one branch of the path tree say nothing about its unlabelled siblings."""

from quadweave.llm.url_filter import url_verdicts


def verdicts(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    return {urls[r.page_id].removeprefix("http://h.com"): r for r in url_verdicts(pages, rules).collect()}


def test_small_branches_of_a_large_host(spark):
    urls = [f"http://h.com/{'de' if i < 4 else 'fr'}/p{i}" for i in range(8)]
    urls += [f"http://h.com/s{k}/page-{i}" for k in range(70) for i in range(25)]
    urls += [f"http://h.com/tiny{k}/page-{i}" for k in range(70) for i in range(2)]
    urls += [f"http://h.com/bad/{w}-{i}" for i in range(12) for w in ("seen", "new")]
    urls += [f"http://h.com/{i}/x" for i in range(1000, 1060)] + [f"http://h.com/77/page-{i}" for i in range(9)]
    rules = (("h.com/de/", "block"), ("h.com/bad/seen", "block"), ("h.com/77/", "block"))
    found = verdicts(spark, urls, rules)
    clean = [r for path, r in found.items() if r.rule is None and not path.startswith("/bad/")]
    assert len(clean) > 1900 and {r.verdict for r in clean} == {"allow"} and {r.purity for r in clean} == {0.5}
    assert found["/s3/page-1"].template.startswith("/s3/") and found["/tiny3/page-1"].template.startswith("/~/")


def test_pools_hold_if_many_labelled_segments_are_alike(spark):
    words = [f"http://h.com/list/w{'o' * (i % 9)}rd-{i}z" for i in range(60)]
    rules = tuple((u.removeprefix("http://"), "block") for u in words[:30])
    found = verdicts(spark, words, rules)
    assert {found[u.removeprefix("http://h.com")].verdict for u in words[30:]} == {"block"}
    mixed = [f"http://h.com/shop-{i}z/item-{k}" for i in range(60) for k in range(4)]
    told = tuple((f"h.com/shop-{i}z/", "block" if i % 8 else "allow") for i in range(40))
    found = verdicts(spark, mixed, told)
    assert {r.verdict for r in found.values() if r.rule is None} == {"allow"}
