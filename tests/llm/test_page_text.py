import numpy as np
import pytest

from lockstep.llm import entries, page_text as pt


def page(i, body="", article="article"):
    open_tag, close = (f"<{article}>", f"</{article.split()[0]}>")
    return (f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li>"
            f"<li><a href='/b'>News {i}</a></li></ul></nav><div class=\"ad\">Buy {i} now</div>{open_tag}<h1>Head {i} &amp; more</h1><p><b>Lead {i}<br><p>Body of\n  the&nbsp;page &lt;{i}&gt; with "
            f"words that go on</p>{body}{close}<footer>&copy; site {i}</footer></body></html>")


WANT = "Head {0} & more\nLead {0}\nBody of the page <{0}> with words that go on"


def test_blocks_of_broken_markup():
    got = [b.text for b in pt.blocks("a<p>b<p>c<b>d</i></b>e<ul><li>f<li>g<ul><li>h</ul>i</ul><!-- x <p> --><script>'<p>'</script>j <3 k<p class='x y'>l &am")]
    assert got == ["a", "b", "cde", "f", "g", "h", "i", "j <3 k", "l &am"]
    assert pt.blocks("") == [] and pt.blocks("<p>") == [] and pt.blocks("<p>x<a href='>y")[0].text == "xy"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    model = pt.Labeller()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, mask = rng.normal(size=(5, 3, pt.WIDTH)), np.ones((5, 3))
    mask[3:, 1] = mask[1:, 2] = 0
    x *= mask[..., None]
    y = (rng.random((5, 3)) < 0.5).astype(float)

    def loss():
        z = model.forward(x, mask)
        return ((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum()

    grads = model.gradients(x, mask, y)
    for name in model.p:
        flat = model.p[name].reshape(-1)
        for i in rng.choice(flat.size, 5):
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert grads[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-3, abs=1e-3)


def test_query_and_edge_cases(spark, tmp_path):
    rows = [(i, f"u{i}", page(i), "t") for i in range(120)]
    rows += [(200, "c", page(200, "<section class='comments'><p>so nice</p></section>"), "t"), (201, "m", page(201, article="main"), "t"),
             (202, "n", None, "t"), (203, None, "", "t"), (None, "x", "no markup", "t"), (5, "u5", page(5), "t")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = entries.op10_page_text(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id is not None and r.page_id < 202:
            assert r.text == WANT.format(r.page_id), r
    assert {r.text for r in got if r.page_id in (202, 203)} == {""}
    bare = str(tmp_path / "none")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{bare}/pages.parquet")
    assert entries.op10_page_text(spark, bare).count() == 0


def test_training_reads_whole_pages(spark, monkeypatch):
    """Every block of a page with 1,500 of them is trained on, its footer included, and pages are taken until the characters are reached."""
    seen = []
    monkeypatch.setattr(pt, "train", lambda pages: seen.append(pages))
    long = page(1, "".join(f"<p>Paragraph {k} with words that go on</p>" for k in range(1500)))
    df = spark.createDataFrame([(i, long) for i in range(5)], "page_id long, html string")
    pt.learn(df)
    assert seen[0] == [long] * 5 and len(long) > 60_000
    monkeypatch.setattr(pt, "TRAINING_CHARS", len(long) + 1)
    pt.learn(df)
    assert seen[1] == [long] * 2


def test_stretches_hold_every_block(monkeypatch):
    counted = []
    monkeypatch.setattr(pt, "EPOCHS", 1)
    monkeypatch.setattr(pt, "varied", lambda p, rng, pool: p)
    old = pt.Labeller.gradients
    monkeypatch.setattr(pt.Labeller, "gradients", lambda self, x, mask, y: (counted.append((len(mask), mask.sum(), y.sum())), old(self, x, mask, y))[1])
    n = 950
    pt.train([page(1, "".join(f"<p>Paragraph {k}</p>" for k in range(n)))])
    blocks = len(pt.blocks(page(1))) + n
    assert max(c[0] for c in counted) <= pt.STRETCH and sum(c[1] for c in counted) == 4 * blocks and sum(c[2] for c in counted) == 4 * (n + 3)


def test_pages_whose_names_say_nothing():
    """The word list knows no name here, and every block is short, so it calls them all furniture; the network goes by words, length, links and place."""
    rng = np.random.default_rng(2)
    words = [f"{a}{b}{c}" for a in "bdglmr" for b in "aeio" for c in ("n", "st", "rk")]
    prose = lambda k: " ".join(rng.choice(words, k))

    def mute(i):
        side = lambda: "".join(f"<div><a href='/{k}'>{prose(2)}</a></div>" for k in range(4))
        return f"<html><body><div class='x1'>{side()}</div><div class='x2'><p>{prose(9)}</p><p>{prose(12)}</p><p>{prose(9)}</p></div><div class='x3'>{side()}</div></body></html>"

    named = [page(i, f"<p>{prose(9)}</p><p>{prose(12)}</p>") for i in range(60)]
    model = pt.train(named)
    pages = [pt.blocks(mute(i)) for i in range(20)]
    right = [(z > 0) == (not b.linked) for p, odds in zip(pages, model.odds(pages), strict=True) for b, z in zip(p, odds, strict=True)]
    listed = [pt.weak_label(b, False) == (not b.linked) for p in pages for b in p]
    assert len({pt.weak_label(b, False) for p in pages for b in p}) == 1
    assert np.mean(right) > np.mean(listed) + 0.1
