"""Labelled pages for the extractor: page layouts, labelled by hand, filled with sentences.

``data-main`` marks where the main text begins, ``data-rest`` what isn't part of it; both hold for all
elements below. In a layout, {T} is a heading, {S} a short sentence, {P} a paragraph, {L} a link's
text, and {*x} repeats ``<p>{P}</p>``-like filler x between one and six times.
"""

from __future__ import annotations

import random

SENTENCES = (
    "Yes.",
    "The bridge opens again in spring.",
    "Nobody had expected so many visitors, and the small museum soon ran out of tickets.",
    "Engineers checked each of the forty cables twice before the first trucks were let across; it took nine nights.",
    "Wer früh kommt, sieht den Nebel über dem Fluss.",
    "Die Gemeinde hat den Plan nach langer Beratung angenommen, will aber im Herbst noch einmal über die Kosten reden.",
    "Le marché ouvre à six heures, sauf le lundi.",
    "Les habitants du quartier ont planté deux cents arbres le long du canal, et ils comptent recommencer l'an prochain.",
    "La biblioteca cierra tarde los jueves.",
    "Los vecinos pidieron más bancos, más sombra y una fuente, y el ayuntamiento aceptó casi todo.",
)
LINKS = ("Home", "News", "About us", "Contact", "Sport", "Impressum", "Mehr", "Accueil", "Culture", "Ayuda", "Next page", "Top")
HEADINGS = ("A bridge reopens", "Short notes", "Nebel über dem Fluss", "Le marché du canal", "Más bancos", "What we learned from ten years of tides")

MENU = '<nav data-rest><ul><li><a href="/a">{L}</a></li><li><a href="/b">{L}</a></li><li><a href="/c">{L}</a></li></ul></nav>'
DIVMENU = '<div class="menu navbar" data-rest><ul><li><a href="/a">{L}</a><li><a href="/b">{L}</a><li><a href="/c">{L}</a></ul></div>'
FOOT = "<footer data-rest>&copy; 2024 {L} &middot; {S}</footer>"
DIVFOOT = '<div id="footer" class="site-footer copyright" data-rest><p>&copy; {L} {S}</p><a href="/t">{L}</a> <a href="/u">{L}</a></div>'
COMMENTS = (
    '<section id="comments" class="comments" data-rest><h2>{L}</h2><div class="comment reply"><p>{P}</p></div>'
    '<div class="comment"><p>{S}</p></div><form><p>{L}</p></form></section>'
)
ARTICLE_COMMENTS = (
    '<section class="comments" data-rest><h2>{L}</h2><article class="comment"><h3>{L}</h3><p>{P}</p></article>'
    '<article id="comment" class="comment"><p>{S}</p></article></section>'
)
DIVCOMMENTS = (
    '<div class="comments discussion" data-rest><h3>{L}</h3><ol class="comment-list"><li class="comment"><p>{P}</p></li>'
    '<li class="comment reply"><p>{P}</p><p>{S}</p></li></ol><div class="respond reply-form"><form><p>{S}</p></form></div></div>'
)
SIDE = '<aside class="sidebar" data-rest><h3>{L}</h3><p>{S}</p><ul><li><a href="/s">{T}</a></li><li><a href="/t">{T}</a></li></ul></aside>'
DIVSIDE = (
    '<div id="sidebar" class="sidebar widget-area" data-rest><div class="widget"><h3>{L}</h3><p>{P}</p></div>'
    '<div class="widget recent related"><ul><li><a href="/s">{T}</a></li><li><a href="/t">{T}</a></li></ul></div></div>'
)
AD = '<div class="ad" data-rest>{S}</div>'
ADS = (
    AD,
    '<div class="ad" data-rest>{P}</div>',
    '<div class="ads advert advertisement banner" data-rest><p>{S}</p></div>',
    '<div class="sponsored promo promotion" data-rest><a href="/x">{T}</a><p>{S}</p></div>',
    '<aside class="ad" data-rest><p>{P}</p></aside>',
    '<section class="advertisement" data-rest><h3>{T}</h3><p>{P}</p></section>',
)
NOTICES = (
    '<div class="cookie consent notice" data-rest><p>{S}</p></div>',
    '<div id="cookie-banner" class="gdpr privacy notice" data-rest>{P}</div>',
    '<div class="alert message popup modal overlay" data-rest><p>{P}</p></div>',
    '<div role="alert" class="notice warning disclaimer" data-rest>{S}</div>',
    '<div class="newsletter subscribe signup" data-rest><h3>{T}</h3><p>{S}</p><form><p>{L}</p></form></div>',
    '<section class="paywall notice" data-rest><p>{P}</p></section>',
)
FORMS = (
    '<form action="/q" data-rest><p>{S}</p><label>{L}</label></form>',
    '<form class="search login" data-rest><div><label>{L}</label>{S}</div></form>',
    '<form class="contact form" data-rest><h3>{T}</h3><p>{P}</p><fieldset>{L}</fieldset></form>',
)
SHARES = (
    '<div class="share social" data-rest><a href="/f">{L}</a> <a href="/g">{L}</a></div>',
    '<div class="breadcrumb breadcrumbs" data-rest><a href="/f">{L}</a> &gt; <a href="/g">{L}</a></div>',
    '<div class="related recommended" data-rest><h3>{L}</h3><ul><li><a href="/f">{T}</a></li><li><a href="/g">{T}</a></li></ul></div>',
    '<ul class="pagination pager tags" data-rest><li><a href="/f">{L}</a></li><li><a href="/g">{L}</a></li></ul>',
    '<div class="author byline meta" data-rest>{L}, <a href="/g">{L}</a></div>',
)
HEADERS = (
    '<header data-rest><h1><a href="/">{L}</a></h1><p>{S}</p></header>',
    '<div id="header" class="header masthead site-header" data-rest><a href="/">{L}</a> <p>{S}</p></div>',
    '<div class="topbar header" data-rest>{S}</div>',
)
BODIES = (
    "<article data-main><h1>{T}</h1>{*<p>{P}</p>}</article>",
    "<article data-main><h1>{T}</h1><p><b>{S}<br>{*<p>{P}</p>}</article>",
    "<article data-main><h1>{T}</h1>{*<p>{S}</p>}<p>{P}<p>{S}<p>{P}</article>",
    "<article data-main><header><h1>{T}</h1><p>{S}</p></header>{*<p>{P}</p>}{X}</article>",
    "<article data-main><h1>{T}</h1><p>{P}</p>{X}{*<p>{P}</p>}<h2>{T}</h2><ul><li>{S}</li><li>{S}</li></ul><p>{S}</p></article>",
    '<article data-main><h1>{T}</h1><section><h2>{T}</h2>{*<p>{P}</p>}</section><div class="text">{*<p>{S}</p>}</div></article>',
    "<main data-main><h1>{T}</h1>{*<p>{P}</p>}<blockquote><p>{S}</p></blockquote></main>",
    "<main data-main><article><h1>{T}</h1>{*<p>{P}</p>}<figure><figcaption>{S}</figcaption></figure></article>{X}</main>",
    '<div id="content" class="content" data-main><h1>{T}</h1>{*<p>{P}</p>}{X}<p>{S}</p></div>',
    '<div class="wrapper container page"><div class="post entry-content article-body" data-main><h2>{T}</h2>{*<p>{P}</p>}</div>{X}</div>',
    '<div class="main" role="main" data-main><div class="story text"><h1>{T}</h1>{*<p>{P}</p>}<pre>{S}</pre></div></div>',
    '<section class="main-content" data-main><h1>{T}</h1>{*<p>{P}</p>}<table><tr><td>{S}</td><td>{S}</td></tr></table></section>',
    '<div class="article" itemprop="articleBody" data-main><h1>{T}</h1>{P}<div>{P}</div><div>{S}</div></div>',
    '<div class="article" data-main><h1>{T}</h1><p>{P}</p><ul><li>{S}</li><li>{P}</li><li>{S}</li></ul></div>',
    '<article data-main><h1>{T}</h1><p>{P}</p><ol><li>{S}</li><li>{S}</li><li>{P}</li></ol>{*<p>{P}</p>}{X}</article>',
    '<div class="content entry" data-main><p>{P}</p><ul><li>{S}</li><li>{S}</li></ul><dl><dt>{T}</dt><dd>{S}</dd></dl></div>',
    "<main data-main><h1>{T}</h1><table><tr><th>{T}</th><th>{T}</th></tr><tr><td>{S}</td><td>{S}</td></tr></table><p>{P}</p></main>",
    '<div class="row"><div class="col"><h1 data-main>{T}</h1><p data-main>{P}</p><p data-main>{P}</p></div></div>',
    "<h1 data-main>{T}</h1><p data-main>{P}</p><p data-main>{S}</p><p data-main>{P}</p>",
    "<div><h1 data-main>{T}</h1><p data-main>{P}</p><p data-main>{P}</p><p data-main>{S}</p></div>",
)
# Layouts without names: text in plain boxes, cells, and right in the body.
PLAIN = (
    "<div><div data-main>{*<p>{P}</p>}</div>{X}</div>",
    '<div data-main><h2>{T}</h2>{*<p>{P}</p>}</div><div data-rest><a href="/v">{L}</a> <a href="/w">{L}</a></div>',
    "<div><div><div data-main><h1>{T}</h1>{*<p>{P}</p>}<p>{S}</p></div></div><div data-rest>{L}</div></div>",
    "<div data-main>{P} {P}</div>",
    "<div><div data-main>{P}<br><br>{P}</div><div data-rest>{L}</div></div>",
    "<center data-main>{P}<br>{P}</center>",
    "<center><h1 data-main>{T}</h1><p data-main>{P}</p><p data-main>{P}</p></center>",
    '<table><tr><td data-rest><a href="/v">{L}</a><br><a href="/w">{L}</a></td><td data-main>{P}<br><br>{P}</td></tr></table>',
    '<table><tr><td data-rest><a href="/v">{L}</a></td><td><h1 data-main>{T}</h1><p data-main>{P}</p><p data-main>{P}</p></td></tr></table>',
)
BARE = ("{P} {P}", "{P}<br><br>{P}<br><br>{P}", "{P}<p>{P}<p>{S}<p>{P}", "<h1>{T}</h1>{P} {P}")


def _fill(layout: str, pick: random.Random) -> str:
    while "{*" in layout:
        start = layout.index("{*")
        stop = layout.index("</p>}", start) + 4
        layout = layout[:start] + layout[start + 2 : stop] * pick.randint(1, 6) + layout[stop + 1 :]
    out = []
    for i, part in enumerate(layout.split("{")):
        if i == 0:
            out.append(part)
            continue
        slot, rest = part[0], part[2:]
        if slot == "P":
            out.append(" ".join(pick.choices(SENTENCES, k=pick.randint(1, 12))))
        elif slot == "X":
            extra = pick.choice((*ADS, *NOTICES, *FORMS, *SHARES, COMMENTS, ARTICLE_COMMENTS, SIDE, "", ""))
            out.append(_fill(extra, pick))
        else:
            out.append(pick.choice({"T": HEADINGS, "S": SENTENCES, "L": LINKS}[slot]))
        out.append(rest)
    return "".join(out)


def _around(body: str, pick: random.Random, mark: str = "") -> str:
    """A page of one body, with other parts drawn around it; ``mark`` is the body element's own label."""
    before = [pick.choice((MENU, DIVMENU)), pick.choice((*HEADERS, "")), pick.choice((*ADS, *NOTICES, ""))]
    after = [
        pick.choice((SIDE, DIVSIDE, "", "")),
        pick.choice((COMMENTS, DIVCOMMENTS, ARTICLE_COMMENTS, "")),
        pick.choice((*ADS, *NOTICES, *FORMS, *SHARES, "")),
        pick.choice((FOOT, DIVFOOT)),
    ]
    if pick.random() < 0.4:
        pick.shuffle(before)
    head = f'<html><head data-rest><meta charset="utf-8"><title>{{T}}</title><style>p{{margin:0}}</style></head><body{mark}>'
    page = "".join(_fill(part, pick) for part in [*before, body, *after])
    return head.replace("{T}", pick.choice(HEADINGS)) + page + "</body></html>"


def labelled_pages(rounds: int = 24, seed: int = 11, without: frozenset[str] = frozenset()) -> list[str]:
    """``rounds`` pages of every body, names or not: a fixed, small set.

    Some plain ones stand alone, with nothing around them. Bodies ``without`` are held out.
    """
    pick = random.Random(seed)
    pages = [_around(body, pick) for _ in range(rounds) for body in BODIES if body not in without]
    for n in range(rounds):
        for body in PLAIN:
            if body not in without:
                pages.append(_around(body, pick) if n % 2 else f"<html><body>{_fill(body, pick)}</body></html>")
        for body in BARE:
            if body not in without:
                alone = f"<html><body data-main>{_fill(body, pick)}</body></html>"
                pages.append(_around(body, pick, " data-main") if n % 2 else alone)
    return pages
