"""Pages written by hand, of layouts and names that no made-up page has; the classifier never sees them."""

import pytest

from torrentine.llm import html_cut, html_samples

A = "The river rises in the hills above the town and runs for some forty kilometres through farmland before it reaches the sea, where a wide estuary is home to thousands of wading birds."
B = "Last winter the water stood two metres above its usual level, and the council had to close three bridges. Repairs are expected to take until autumn, according to a spokesman for the county."
C = "Local anglers say that trout have come back since the old weir was taken down in 2019. “We did not think it would go so fast,” said one of them."
MENU = '<a href="/">Home</a> <a href="/news">News</a> <a href="/sport">Sport</a> <a href="/about">About Us</a>'
ITEMS = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/contact">Contact Us</a></li></ul>'

PAGES = {
    "hashed names": (f'<body><div class="css-1x2y"><div class="css-9k3">{MENU}</div><div class="sc-abc"><h1 class="css-77a">Floods on the river</h1><p class="css-p1">{A}</p><p class="css-p1">{B}</p></div><div class="css-f00">© 2024 Daily Paper</div></div></body>', ["Floods on the river", A, B]),
    "css modules": (f'<div id="__next"><div class="_3xKq9">{ITEMS}</div><div class="_9sLw2"><div class="_1aBc"><h1 class="_7Yt">Floods on the river</h1><div class="_2Zz">{A}</div><div class="_2Zz">{B}</div><div class="_2Zz">{C}</div></div></div></div>', ["Floods on the river", A, B, C]),
    "table": (f'<table width="100%"><tr><td>{MENU}</td></tr><tr><td><h1>Floods on the river</h1><p>{A}</p><p>{B}</p></td></tr><tr><td>Copyright 1999</td></tr></table>', ["Floods on the river", A, B]),
    "table, column": (f'<body><table border="0"><tr><td width="120">Home<br>News<br>Links</td><td><font size="5"><b>Floods on the river</b></font><p>{A}<p>{B}</td></tr></table></body>', None),
    "table, column of links": (f'<body><table border="0"><tr><td width="120"><a href="1">Home</a><br><a href="2">News</a><br><a href="3">Links</a></td><td><h1>Floods on the river</h1><p>{A}<p>{B}</td></tr></table></body>', ["Floods on the river", A, B]),
    "bare text": (f"<body><h1>Floods</h1>{A}<br><br>{B}</body>", ["Floods", f"{A} {B}"]),
    "bare text, menu": (f"<html><body><div>{MENU}</div><h2>Floods on the river</h2>{A}<br><br>{B}<hr>{MENU}</body></html>", ["Floods on the river", f"{A} {B}"]),
    "plain divs": (f"<div><div>{MENU}</div><div><h1>Floods on the river</h1><div>{A}</div><div>{B}</div></div><div>{ITEMS}</div></div>", ["Floods on the river", A, B]),
    "short article": (f'<div class="x1"><div class="x2">{ITEMS}</div><div class="x3"><h1>Floods</h1><p>{A}</p></div><div class="x4"><a href="#">Imprint</a> <a href="#">Privacy</a></div></div>', ["Floods", A]),
    "hashed, share and related": (f'<div class="a8f"><div class="q1z">{ITEMS}</div><div class="m2k"><h1 class="t0p">Floods on the river</h1><p class="bb1">{A}</p><div class="sh4">Share this article</div><p class="bb1">{B}</p><p class="bb1">{C}</p></div><div class="r9x"><h3>Related articles</h3>{ITEMS}</div></div>', ["Floods on the river", A, B, C]),
    "other names": (f'<div class="masthead-strip">{MENU}</div><div class="reading-pane"><h1>Floods on the river</h1><p>{A}</p><h2>What comes next</h2><p>{B}</p><p>{C}</p></div><div class="bottom-strip"><p>© 2024 Daily Paper. All rights reserved.</p></div>', ["Floods on the river", A, "What comes next", B, C]),
    "list within": (f'<div class="k1"><div class="k2">{ITEMS}</div><div class="k3"><h1>Floods on the river</h1><p>{A}</p><ul><li>three bridges are closed to cars and lorries</li><li>the ferry runs twice a day, weather permitting</li></ul><p>{B}</p></div></div>', ["Floods on the river", A, "three bridges are closed to cars and lorries", "the ferry runs twice a day, weather permitting", B]),
    "cookie text": (f'<div class="z9"><p>We use cookies to improve your experience. By continuing you accept our policy.</p><button>OK</button></div><div class="z1"><h1>Floods on the river</h1><p>{A}</p><p>{B}</p></div>', ["Floods on the river", A, B]),
    "elements without names": (f"<header>{MENU}</header><main><h1>Floods on the river</h1><p>{A}</p><p>{B}</p></main><aside><h3>Most read</h3>{ITEMS}</aside><footer><p>© 2024</p></footer>", ["Floods on the river", A, B]),
    "quote": (f'<div><div>{ITEMS}</div><div><h1>Floods on the river</h1><p>{A}</p><blockquote>{C}</blockquote><p>{B}</p></div></div>', ["Floods on the river", A, C, B]),
}


#: Labels without links in a cell like any other are taken for text.
LOST = pytest.mark.xfail(strict=True, reason="a menu without links, names or elements")


@pytest.mark.parametrize("layout", [pytest.param(x, marks=LOST) if x == "table, column" else x for x in PAGES])
def test_layouts(layout):
    page, want = PAGES[layout]
    got = html_cut.main_text(page).split("\n")
    if want is None:  # a title in bold is a line of its own only by its looks
        assert any(A in x for x in got) and B in got and not any("News" in x for x in got)
    else:
        assert got == want


def test_weights_are_those_of_the_sample():
    fresh, stored = html_cut.fit(html_samples.pages()), html_cut.fitted()
    assert set(fresh) == set(stored) and all(abs(fresh[k] - stored[k]) < 1e-3 for k in fresh)
