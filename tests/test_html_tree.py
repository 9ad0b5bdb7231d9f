"""Nested elements against trees that are known, and against html.parser."""
import random
import time
from html.parser import HTMLParser

from postsift.sources.html_tree import read_elements
from postsift.sources import html


def tree(rnd, depth, out, parent):
    """(source, what the element around keeps of it); the elements looked for go to ``out``."""
    source, kept = [], []
    for _ in range(rnd.randint(0, 4)):
        kind = rnd.choice("tcsvdlp" if depth else "tcsv")
        if kind in "tv":
            s = rnd.choice(["text", "a < b ", "&lt;li&gt;", "1 > 0"]) if kind == "t" else rnd.choice(['<br>', '<img alt="</li>">', "<hr/>", "<input value='>'>"])
            source.append(s)
            kept.append(s)
        elif kind == "c":
            source.append(rnd.choice(['<!-- </li> -->', '<!---->', '<!--<li class="item">-->']))
        elif kind == "s":
            source.append('<script type="x">"</li>" + \'<li class="item">\'</script>')
            kept.append('<script type="x"></script>')
        elif kind == "d":
            s, k = tree(rnd, depth - 1, out, parent)
            source.append(f"<div data-x='class=item'>{s}</DIV>")
            kept.append(f"<div data-x='class=item'>{k}</DIV>")
        else:
            mine = kind == "p"
            tag = rnd.choice(['<li class="a item b">', "<LI id=1 class=item>"]) if mine else rnd.choice(["<li>", '<li class="items">'])
            at = len(out)
            if mine:
                out.append(None)
            s, k = tree(rnd, depth - 1, out, at if mine else parent)
            end = rnd.choice(["</li>", "</li >", ""])
            source.append(f"<ul>{tag}{s}{end}</ul>")
            if mine:
                out[at] = (tag + k + end, parent)
                kept.append("<ul></ul>")
            else:
                kept.append(f"<ul>{tag}{k}{end}</ul>")
    return "".join(source), "".join(kept)


class Starts(HTMLParser):
    def __init__(self):
        super().__init__()
        self.n = 0

    def handle_starttag(self, tag, attrs):
        self.n += tag == "li" and "item" in (dict(attrs).get("class") or "").split()


def test_known_trees_and_html_parser():
    rnd, most = random.Random(5), 0
    for _ in range(1500):
        out = []
        source, _ = tree(rnd, 4, out, None)
        got = [(e["html"], e["parent"]) for e in read_elements(source, "li", "item")]
        assert got == out, source
        p = Starts()
        p.feed(source)
        p.close()
        assert p.n == len(out)
        most = max(most, len(out))
    assert most > 5


def test_broken_pages():
    def sources(s):
        return [e["html"] for e in read_elements(s, "li", "x")]
    assert sources(None) == sources("") == sources("<li>a</li>") == []
    assert sources("<li class=x>a<li class=x>b") == ["<li class=x>a", "<li class=x>b"]              # implied end
    assert sources("<li class=x>a</b></li></li>z") == ["<li class=x>a</b></li>"]                     # ends of nothing
    assert sources("<div><li class=x>a<b>c</div>z") == ["<li class=x>a<b>c"]                         # ended from outside
    assert sources("<li class=x>a<ul></li>b</ul></li>z") == ["<li class=x>a<ul></li>b</ul></li>"]    # an end in another list
    assert sources("<li class=x>a<!-- </li>") == ["<li class=x>a"]
    assert sources('<li class=x>a<b title="</li>') == ["<li class=x>a"]
    assert sources("<li class=x>a<script></li>") == ["<li class=x>a<script>"]
    assert sources("<li class='y' class='x'>a</li>") == []                                           # the first attribute counts
    assert sources("<!DOCTYPE html><?x?></3><li class=x>a</li>") == ["<li class=x>a</li>"]


def test_long_pages_take_linear_time():
    n = 200_000
    start = time.time()
    for s in ("<div>" * n, "<li class=x>" * n, "<ul><li class=x>" * (n // 4), '<a "' * n, "<!--" * n, "<" * n, "</li>" * n, "<script>" * n,
              "<b>" + "</i>" * n, "<a " + "x=" * n):
        read_elements(s, "li", "x")
    assert time.time() - start < 30


def test_pages_as_rows(spark):
    rows = [(1, '<ol><li class="js-stream-item"><div class="js-stream-tweet" data-name="a" data-conversation-id="1"><p class="TweetTextSize">one</p>'
                '<ol><li class="js-stream-item"><div class="js-stream-tweet" data-name="b" data-conversation-id="2"><p class="TweetTextSize">two</p></div></li></ol>'
                '</div></li></ol>'), (2, None), (3, "")]
    out = html.page_posts_nested(spark.createDataFrame(rows, "page_id long, html string")).orderBy("pos").collect()
    assert [(r.page_id, r.pos, r.seq, r.parent, r.user_name, r.tweet_id, r.text) for r in out] == [(1, 0, 1, None, "a", 1, "one"), (1, 1, 0, 0, "b", 2, "two")]
