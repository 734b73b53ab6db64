"""Main texts of hand-made page shapes, and long rule lists."""

import random
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from changeloom.llm import html_text, url_filter  # noqa: E402
from changeloom.llm.queries import HOST_RULES  # noqa: E402
from changeloom.session import ship_package  # noqa: E402

ONE = ("The old house stood in the middle of the garden, and it had been there for as long as anyone in the village could remember. "
       "Nobody knew who had built it or why the door was painted blue.")
TWO = ("In the evening the children came back from the river with wet shoes and told a story that was longer than the way home. "
       "It was the kind of story that is better when it is told twice.")
JAPANESE = "これは長い文章です。日本語の本文がここにあります。記事の内容を詳しく説明しています。" * 6
POLISH = ("Stary dom stał pośrodku ogrodu i nikt nie wiedział, kto go zbudował. Wieczorem dzieci wracały znad rzeki. "
          "Opowiadały długą historię. Potem wszyscy szli spać, bo następnego dnia czekała ich ciężka praca w polu.")
MENU = "".join(f'<li><a href="/{w}">{w.title()}</a></li>' for w in "home about products support contact careers".split())
CHATTER = "I do not agree with any of this and I think that the author has not been to the village at all. " * 3


def page(body, attributes=""):
    return f"<html><head><title>t</title></head><body{attributes}>{body}</body></html>"


def prose(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


# (page, its main text as a reader would mark it)
SHAPES = [
    (page(f'<div class="site has-sidebar">{prose(ONE, TWO)}</div>'), [ONE, TWO]),
    (page(f'<main class="content no-sidebar">{prose(ONE, TWO)}</main>'), [ONE, TWO]),
    (page(f'<article class="post comment-open">{prose(ONE, TWO)}</article>'), [ONE, TWO]),
    (page(f'<div class="social-science">{prose(ONE, TWO)}</div>'), [ONE, TWO]),
    (page(f"<div>{prose(JAPANESE)}</div>"), [JAPANESE]),
    (page(f"<div>{prose(POLISH)}</div>"), [POLISH]),
    (page(f'<div class="comments-closed post">{prose(ONE, TWO)}</div>'), [ONE, TWO]),
    (page(f'<div id="share-price-report">{prose(ONE, TWO)}</div>'), [ONE, TWO]),
    (page(f'<div class="notice-period">{prose(ONE)}</div>{prose(TWO)}'), [ONE, TWO]),
    (page(f'<ul class="menu">{MENU}</ul><div id="content">{prose(ONE, TWO)}</div>'), [ONE, TWO]),
    (page(f"<nav><ul>{MENU}</ul></nav>{prose(ONE, TWO)}<footer><p>{CHATTER}</p></footer>"), [ONE, TWO]),
    (page(f'{prose(ONE, TWO)}<div class="comment-list"><p>{CHATTER}</p></div>'), [ONE, TWO]),
    (page(f'{prose(ONE, TWO)}<div id="reader-comments"><div><p>{CHATTER}</p></div></div>'), [ONE, TWO]),
    (page(f'{prose(ONE, TWO)}<div class="commentList"><p>{CHATTER}</p></div>'), [ONE, TWO]),
    (page(f'<div class="siteNav"><p>{CHATTER}</p></div>{prose(ONE, TWO)}'), [ONE, TWO]),
    (page(f'<div class="left sidebar"><p>{CHATTER}</p></div>{prose(ONE, TWO)}'), [ONE, TWO]),
    (page(f'<div class="page-footer"><p>{CHATTER}</p></div>{prose(ONE, TWO)}'), [ONE, TWO]),
    (page(f'<div class="related-posts"><p>{CHATTER}</p></div>{prose(ONE, TWO)}'), [ONE, TWO]),
    (page(f'<div class="social-buttons"><p>{CHATTER}</p></div>{prose(ONE, TWO)}'), [ONE, TWO]),
    (page(f'<div class="ad"><p>{CHATTER}</p></div>{prose(ONE, TWO)}'), [ONE, TWO]),
    (page(f'<div role="complementary"><p>{CHATTER}</p></div>{prose(ONE, TWO)}'), [ONE, TWO]),
    (page(f'<div class="cookie-consent"><p>{CHATTER}</p></div>{prose(ONE, TWO)}'), [ONE, TWO]),
    (page(f"<form><p>{CHATTER}</p></form>{prose(ONE, TWO)}"), [ONE, TWO]),
    (page(f"<script>{CHATTER}</script><style>p {{}}</style>{prose(ONE, TWO)}"), [ONE, TWO]),
    (page(f"<article><header><h1>Title of it</h1></header>{prose(ONE, TWO)}</article><p>{CHATTER}</p>"), ["Title of it", ONE, TWO]),
    (page(f"<article>{prose(ONE, 'Short line.', TWO)}</article>"), [ONE, "Short line.", TWO]),
    (page(f"{prose(ONE)}<p>Yes.</p>{prose(TWO)}"), [ONE, "Yes.", TWO]),
    (page(f"<table><tr><td>{MENU}</td><td>{prose(ONE, TWO)}</td></tr></table>"), [ONE, TWO]),
    (page(prose(ONE, TWO), ' class="home has-nav menu-open"'), [ONE, TWO]),
    (page(f"<p>{ONE.replace('and', '&amp;')}</p><!-- {CHATTER} -->"), [ONE.replace("and", "&")]),
    (page(f'<ul class="menu">{MENU}</ul>'), []),
    (page(f"<div><p>{'buy now cheap pills online store discount ' * 12}</p></div>"), []),
]


def f1(found, wanted):
    a, b = Counter(found.split()), Counter(wanted.split())
    both = sum((a & b).values())
    return 1.0 if not a and not b else 2 * both / max(1, sum(a.values()) + sum(b.values()))


def test_main_texts_of_page_shapes():
    scores = [f1(html_text.main_text(h), "\n".join(t)) for h, t in SHAPES]
    assert sum(scores) / len(scores) > 0.95 and min(scores) > 0.9, [(SHAPES[i][0][:90], s) for i, s in enumerate(scores) if s < 1]


def test_long_rule_lists_are_joined(spark, small_dir, monkeypatch):
    ship_package(spark)
    rng = random.Random(2)
    pages = spark.read.parquet(f"{small_dir}/pages.parquet").select("page_id", "url")
    odd = [(-1, None), (-2, "nowhere"), (-3, "http://a.example.com/en/x"), (-3, "http://a.example.com/en/x"), (-4, "ftp://x.net"), (-5, "http:///")]
    urls = pages.unionByName(spark.createDataFrame(odd, "page_id bigint, url string")).withColumn("rule", url_filter.F.lit("mine"))
    hosts = [".".join(rng.choice(["www", "a", "example", "site", "shop"]) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    rules = HOST_RULES + [url_filter.Rule(rng.choice(["allow", "block"]), f"{h}.{rng.choice(['com', 'net'])}/{rng.choice(['', 'en/', 'de/'])}")
                          for h in hosts]
    rules = list({r.text: r for r in rules}.values())
    patterns = (*url_filter.PATTERNS, url_filter.Rule("block", "*x*"), url_filter.Rule("block", "*-*-*"))
    literal = sorted(map(str, url_filter.judged(urls, rules, patterns).collect()))
    monkeypatch.setattr(url_filter, "LITERAL_RULES", 10)
    joined = url_filter.judged(urls, rules, patterns)
    assert sorted(map(str, joined.collect())) == literal
    assert "Python" not in joined._jdf.queryExecution().executedPlan().toString()
    assert url_filter.judged(urls.limit(0), rules, patterns).count() == 0


def test_very_many_rules(spark, small_dir):
    ship_package(spark)
    pages = spark.read.parquet(f"{small_dir}/pages.parquet").select("page_id", "url")
    many = [url_filter.Rule("block", f"host{i}.com/p{i % 7}/") for i in range(30_000)]
    plain = {r.page_id: (r.rule, r.verdict) for r in url_filter.judged(pages, HOST_RULES).collect()}
    out = {r.page_id: (r.rule, r.verdict) for r in url_filter.judged(pages, [*HOST_RULES, *many]).collect()}
    assert out == plain
