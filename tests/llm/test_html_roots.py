"""Pages whose text is not in exactly one article."""

import pytest

from stridelake.llm.html_text import main_text

LONG = [f"Paragraph {i} {'of real text ' * 12}".strip() for i in range(4)]
P = "".join(f"<p>{t}</p>" for t in LONG)
TEXT = "\n".join(LONG)
NAV = "<nav><a href=1>Home</a></nav>"


@pytest.mark.parametrize(
    "body, want",
    [
        (f"<main><h1>Head</h1><article>{P}</article></main>", f"Head\n{TEXT}"),
        (f"<div><article>{P}</article><article><p>Second one</p></article></div>", f"{TEXT}\nSecond one"),
        (f"<main>{P}<article><p>A short teaser</p></article></main>", f"{TEXT}\nA short teaser"),
        (f"<main>{P}</main><article><p>A short teaser</p></article>", TEXT),
        (f"<div class=elementor-widget-container><article>{P}</article></div>", TEXT),
        (f"<div class='layout-sidebar-left'><main><h1>Head</h1>{P}<div class=sidebar><p>Other</p></div></main></div>", f"Head\n{TEXT}"),
        (f"<article class='post layout-sidebar-left'>{P}</article>", TEXT),
        (f"<article>{P}</article><section id=comments>" + f"<article><p>{'Reader says much ' * 9}</p></article>" * 9 + "</section>", TEXT),
    ],
)
def test_root_of_the_text(body, want):
    assert main_text(f"<html><body>{NAV}{body}<footer><p>Rights</p></footer></body></html>") == want
