"""Pages written by hand, whose elements carry none of the names that training pages use for the content."""

import pytest

from palimpsest.llm import html_text as H

P1 = "The council voted on Tuesday evening to reopen the old railway bridge to walkers and cyclists, ending a dispute that has run for eleven years."
P2 = "Engineers who inspected the iron spans in March found less rust than they had feared, and said that the repairs would take two summers at most."
P3 = "Residents on the eastern bank, who must now take a long way round by road, welcomed the decision but asked for lights and a handrail."
LINKS = ["World", "Business", "Sport", "Weather", "Travel"]
TOP = "".join(f'<a href="/{w}">{w}</a> ' for w in LINKS)
ITEMS = "".join(f'<li><a href="/{k}">{t}</a></li>' for k, t in enumerate(["Harbour wall to be raised", "Market moves to Friday", "School wins chess cup"]))

PAGES = {
    "columns": (f'<body><div class="wrap"><div>{TOP}</div><div class="col8"><h1>Bridge to reopen</h1><p>{P1}</p><p>{P2}</p><table><tr><td>Length</td><td>212 metres</td></tr><tr><td>Built</td><td>1884</td></tr></table></div><div class="col4"><h3>Elsewhere</h3><ul>{ITEMS}</ul></div></div><div>&copy; 2024 The Courier</div></body>', ["Bridge to reopen", P1, P2, "Length", "212 metres", "Built", "1884"]),
    "table layout": (f'<body><table width="100%"><tr><td colspan="2">{TOP}</td></tr><tr><td valign="top"><ul>{ITEMS}</ul></td><td><h2>Bridge to reopen</h2><p>{P1}<p>{P2}<p>{P3}</td></tr></table><center>&copy; 1999 Courier</center></body>', ["Bridge to reopen", P1, P2, P3]),
    "line breaks": (f"<body><center>{TOP}</center><h1>Bridge to reopen</h1>{P1}<br><br>{P2}<br><br>{P3}<br><hr>{TOP}</body>", ["Bridge to reopen", P1, P2, P3]),
    "nested": (f'<body><div id="x1"><ul>{ITEMS}</ul></div><div id="x2"><div><div><h1>Bridge to reopen</h1></div><div><div>{P1}</div><div>{P2}</div><blockquote>{P3}</blockquote></div></div></div><div id="x3"><b>Read next</b><div>{ITEMS}</div></div></body>', ["Bridge to reopen", P1, P2, P3]),
    "bare": (f"<h1>Bridge to reopen</h1><p>{P1}</p><p>{P2}</p>", ["Bridge to reopen", P1, P2]),
    "list inside": (f'<body><div class="g">{TOP}</div><div class="z"><h1>Bridge to reopen</h1><p>{P1}</p><h3>What is planned</h3><ul><li>New planks on both spans by June.</li><li>A handrail along the northern side.</li></ul><p>{P2}</p></div><div class="q">&copy; 2020 Courier. <a href="/t">Terms</a></div></body>', ["Bridge to reopen", P1, "What is planned", "New planks on both spans by June.", "A handrail along the northern side.", P2]),
}


@pytest.fixture(scope="module")
def weight():
    return H.train(H.labelled_pages() + H.plain_pages())


def f1(got, want):
    from collections import Counter

    a, b = Counter(got.split()), Counter(want.split())
    return 2 * sum((a & b).values()) / max(1, a.total() + b.total())


def test_pages_of_other_make(weight):
    scores = {k: f1(H.extract(html, weight), "\n".join(want)) for k, (html, want) in PAGES.items()}
    assert sum(scores.values()) / len(scores) >= 0.9 and min(scores.values()) >= 0.8, scores


def test_columns_keep_heading_paragraphs_and_table(weight):
    got = H.extract(PAGES["columns"][0], weight).split("\n")
    assert set(PAGES["columns"][1]) <= set(got)


@pytest.mark.parametrize("how", ["hidden", 'style="display: none"', "HIDDEN=''", 'style="visibility:hidden"'])
def test_hidden_blocks_are_out(weight, how):
    for page in (f"<article><h1>T</h1><p>{P1}</p><p {how}>{P2}</p><p>{P3}</p></article>", f"<h1>T</h1><p>{P1}</p><div {how}><p>{P2}</p></div><p>{P3}</p>"):
        got = H.extract(page, weight).split("\n")
        assert P2 not in got and P1 in got and P3 in got


@pytest.mark.parametrize("how", ['class="overflow-hidden"', 'class="a hidden-sm"', 'hidden="false"', 'data-x="hidden"', 'title="none hidden"'])
def test_names_hide_nothing(weight, how):
    assert P2 in H.extract(f"<article><h1>T</h1><p>{P1}</p><p {how}>{P2}</p></article>", weight).split("\n")
