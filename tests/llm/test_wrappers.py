"""Articles inside containers whose class, id or role only sounds like a menu, a notice or an advert."""

import pytest

from tessella.llm.extraction import extract

LONG = "The river ran along the quiet stone and the light of the north was in the paper of the house for all to see. " * 2
OTHER = "A quite different notice that is long enough to be taken for a paragraph of the article by its length alone, if nothing else were known of it. "


@pytest.mark.parametrize("attributes", ["class='page has-sidebar'", "class=with-comments", "class='header-fixed'", "id=sidebar-left", "class='page hasSidebar'", "class='no-form'", "role=search", "class='modal-open widget'"])
@pytest.mark.parametrize("element", ["article", "main"])
def test_wrapped_article_stays(attributes, element):
    page = f"<body><nav>{OTHER}</nav><div {attributes}><section class=promo-wide><{element}><h1>Title</h1><p>{LONG}</p></{element}></section><p>{OTHER}</p></div></body>"
    assert extract(page) == f"Title\n{LONG.strip()}"


def test_a_class_that_says_what_is_there_marks_nothing():
    assert extract(f"<div class='page has-sidebar'><p>{LONG}</p></div><div class=sidebar><p>{OTHER}</p></div>") == LONG.strip()


@pytest.mark.parametrize("box", ["<div role=navigation>{}</div>", "<aside>{}</aside>", "<footer>{}</footer>", "<form>{}</form>", "<div class=comments>{}</div>", "<div id=comment-list>{}</div>", "<div class='header-fixed'><div class=replies>{}</div></div>"])
def test_what_is_no_layout_stays_out(box):
    assert extract("<div>" + box.format(f"<article><p>{OTHER}</p></article>") + f"</div><p>{LONG}</p>") == LONG.strip()


def test_marks_inside_and_beside_the_article_hold():
    page = f"<div class=has-sidebar><div class=header-fixed><article><p>{LONG}</p><div class=ad><p>{OTHER}</p></div><p>{LONG}</p></article></div><p>{OTHER}</p></div>"
    assert extract(page) == f"{LONG.strip()}\n{LONG.strip()}"
    for outer in ("{}", "<div class=header-fixed>{}</div>"):
        both = f"<article><p>{LONG}</p></article><div class=related><article><p>{OTHER}</p></article></div>"
        assert extract(outer.format(both)) == LONG.strip()
    assert extract(f"<main><h1>Title</h1><div class=header-fixed><article><p>{LONG}</p></article></div></main>").endswith(LONG.strip())
