"""Inline elements, hidden elements and comment containers of pages."""

import html
import random

from hubbub.llm import html_text

WEIGHTS = html_text.Weights({"p": 1.0, "article": 1.0, "main": 1.0}, {}, dict.fromkeys(html_text.INLINE, -0.01) | {"p": -0.5})
TEXT = "<p>Some words of an article that go on for a while and then end here.</p>"


def text(page):
    return html_text.main_text(page, WEIGHTS)


def test_inline_elements_never_cut_a_block():
    """Pages with inline elements of all kinds read as the same pages without their tags."""
    rng = random.Random(7)
    marks = ["", " class=hl", ' class="ext link"', " id=q7", ' role="term"', ' title="a hidden gem"', ' style="color: red"', " data-x=1"]
    for _ in range(300):
        plain, marked, told = [], [], []
        for _ in range(rng.randrange(1, 6)):
            words = [rng.choice(["one", "two", "it's", "R&D", "déjà", "vu,"]) for _ in range(rng.randrange(4, 30))]
            out = []
            for w in words:
                w = html.escape(w)
                for _ in range(rng.choice([0, 0, 1, 2])):
                    tag = rng.choice(["span", "a", "em", "code", "b", "abbr", "mark", "cite", "time"])
                    w = f"<{tag}{rng.choice(marks)}>{w}</{tag}>"
                if rng.random() < 0.1:
                    w = w[: len(w) // 2] + "<wbr>" + w[len(w) // 2 :] if w.isalpha() else w
                out.append(w)
            plain.append("<p>" + " ".join(map(html.escape, words)) + "</p>")
            marked.append("<p>" + rng.choice([" ", "\n "]).join(out) + "</p>")
            told.append(" ".join(words))
        assert text("\n".join(marked)) == text("\n".join(plain)) == "\n\n".join(told)


def test_inline_elements_that_stand_aside_leave_their_block():
    assert text("<p>one two three <span class=share>Share me</span> four five six</p>") == "one two three four five six"
    assert text("<p>one two <em>three <a class='social' href=x>post it</a> four</em> five</p>") == "one two three four five"
    assert text("<p>Hello <span class=hl>big</span> world of words</p>") == "Hello big world of words"


def test_hidden_elements():
    for mark in ("hidden", "hidden=''", 'style="display: none"', "style='color:red;visibility:hidden'", "class=x hidden"):
        assert text(f"<p>one two three</p><p {mark}>secret</p><p>four five six</p>") == "one two three\n\nfour five six", mark
        assert text(f"<p>one two three <span {mark}>secret</span> four</p>") == "one two three four", mark
    assert text('<p>one two <img alt="a hidden gem"> three four</p><p title="hidden">five six seven</p>') == "one two three four\n\nfive six seven"
    assert text('<p style="display:nonexistent">one two three</p>') == "one two three"


def test_comment_containers():
    told = "\n\n".join(["Some words of an article that go on for a while and then end here."] * 3)
    for name in ("comment-thread", "comments_wrapper", "comments-section", "disqus-container", "comment-list"):
        assert text(TEXT * 3 + f"<div class={name}><p>I disagree with all of this, and strongly so, as you see.</p></div>") == told, name
    for name in ("comments-open", "has-comments", "comment-count", "commentary"):
        assert text(f"<div class={name}>{TEXT * 3}</div>") == told, name
    assert html_text.comments_name("comment-thread") and not html_text.comments_name("no-comments") and not html_text.comments_name("commentator")
