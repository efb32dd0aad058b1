"""Labelled pages for training the extraction model, and others held out.

A layout is a page with slots.  An element with ``data-gold="1"`` is content with
all below it, one with ``data-gold="0"`` is not; the page itself is not.  The
attribute is read as the label alone and is never a feature.  Slots are filled
from word lists, so that lengths vary: {h} a heading, {p} a paragraph, {s} a
sentence, {w} a label of one or two words, {m} a menu of links, {l} a link.
"""

from __future__ import annotations

import random
import re

SENTENCES = """The river rose again on Monday, and people left their homes.|Officials said that the bridge would stay closed until the water falls.
The city opened a park by the lake.|More than two hundred trees were planted in one week by the residents, who had asked for it for years.
Mix the flour and the water, then wait for an hour.|Let the bread cool before you cut it, or the crumb will be wet.|It began with a letter that no one could read.
Years went by.|Nobody had expected that it would come from so far away.|The committee will meet in the autumn to decide what happens next.
Prices rose by three percent, the bank said.|"We did not see it coming," the captain told us after the match.|Why does the engine stop when it is cold?
The function returns a list of all values that are larger than the limit.|Set the option to false if the server has no disk.|No.
Der Brief kam am Morgen, und niemand wusste, von wem er war.|Nein, das war nicht alles.|Die Schule bleibt bis zum Ende der Woche geschlossen.
Le lac était calme ce matin, et personne ne parlait.|Les habitants attendent toujours une réponse de la mairie.|La casa era grande y vieja.
Los vecinos la miraban desde lejos, porque nadie vivía allí desde hacía años.|El tren sale a las ocho de la mañana.
The court held that the copyright in the archive was the city's, and that its sale needed consent.|She baked one cookie for every guest, shared the recipe with readers and asked them to follow it.
AND THEN THE WATER CAME!! ALL OF IT!! AT ONCE!!|NOBODY KNEW WHAT TO DO|the old road went up the hill and nobody had walked it for a long time""".replace("\n", "|").split("|")
HEADINGS = "River levels rise|A new park by the lake|How to bake bread|Long read: the second letter|Notes|Ein Brief|Le lac|Casa|What the bank said|Getting started with the server|Short|Where did they go? A story in three parts".split("|")
LABELS = "Home|News|Sport|World|About us|Contact|Archive|May 2019|Sign in|Start|Inicio|Monde|Kontakt|Business|Shop|Help|Blog|Part one|Photos|Video".split("|")

#: Layouts of which the model is trained, by kind of page.
LAYOUTS = {
    "article": "<nav>{m}</nav><div class='ad'>{s}</div><article data-gold=1><h1>{h}</h1><p><b>{p}<br><p>{p}</p><p>{p}</p></article><footer>&copy; example.com &middot; {s} {s}</footer>",
    "article, bare": "<nav>{m}</nav><div class='ad'>{s} {s}</div><article data-gold=1><h1>{h}</h1><p>{w}.</article><footer>&copy; a.example.org &middot; {p}</footer>",
    "article, heading alone": "<nav>{m}</nav><div class='ad'>{w}.</div><article data-gold=1><h1>{s}</h1></article><footer>&copy; example.org</footer>",
    "news": "<header><h1>{w}</h1><p>{w} since 1900</p><nav>{l} {l} {l}</nav></header><main><article data-gold=1><h1>{h}</h1><p>{p}</p><h2>{w}</h2><p>{p}</p><blockquote><p>{s}</p></blockquote>"
            "<table><tr><th>{w}</th><th>{w}</th></tr><tr><td>2019</td><td>200</td></tr></table></article><aside><h3>Related</h3>{m}</aside></main><footer><p>Contact us</p>{m}</footer>",
    "story": "<div class='cookie-notice'><p>We use cookies to make this site better. {s}</p><button>OK</button></div><header class='site-header'><p>{w}</p></header><nav class='breadcrumb'>{m}</nav>"
             "<article class='story' data-gold=1><h1>{h}</h1><section><h2>{w}</h2><p>{s}</p><p>{p}</p></section><div class='ad' data-gold=0>Sponsored: {s}</div><section><h2>{w}</h2><p>{p}</p></section>"
             "<aside class='sidebar' data-gold=0><p>Sign up and never miss a story.</p></aside><section id='comments' data-gold=0><h2>Reader comments</h2><ul><li><p>{s} {s}</p></li><li>{s}</li></ul></section>"
             "<form data-gold=0><p>Leave a reply</p><label>Name</label></form></article><footer><p>Imprint</p></footer>",
    "blog": "<div id='header'>{l}</div><div id='menu'>{m}</div><div id='content' data-gold=1><div class='post'><h2>{h}</h2><div class='entry'><p>{p}</p><ol><li>{s}</li><li>{s}</li></ol><p>{p}</p></div></div>"
            "<div class='comments' data-gold=0><h3>3 comments</h3><div class='comment'><p>{s} {s}</p></div><div class='comment'><p>{s}</p></div></div></div>"
            "<div class='sidebar'><h3>Archive</h3><p>{s}</p>{m}</div><div id='footer'><p>Powered by a blog.</p></div>",
    "blog, other names": "<div class='topbar'><div class='login'>Sign in</div></div><div class='wrapper'><div class='main-content' data-gold=1><h1>{h}</h1><div>{p}</div><div>{s}</div><dl><dt>{w}</dt><dd>{s}</dd></dl>"
                         "<figure><figcaption>{w}</figcaption></figure></div><div class='single-post-comments'><h4>Comments</h4><div>{s} {s}</div><div>{s}</div></div>"
                         "<div class='widget related'><h4>You may also like</h4>{m}</div><div class='newsletter'><form><p>Get our news by mail every week. Subscribe now.</p></form></div></div><div class='footer'><p>Legal notice and privacy.</p></div>",
    "divs": "<div>{l} {l} {l} {l}</div><div data-gold=1>{h}</div><div data-gold=1>{p}</div><div data-gold=1>{p}</div><div data-gold=1>{p}</div><div>Copyright 2019. All rights reserved.</div>",
    "divs alone": "<div data-gold=1>{h}</div><div data-gold=1>{p}</div><div data-gold=1>{p}</div>",
    "nested divs": "<div><div>{l}</div><div>{l} | {l} | {l}</div></div><div><div data-gold=1><div>{h}</div><div>{p}</div><div>{p} {p}</div></div><div><div>{w}</div>{m}</div></div><div>{l} {l} Terms of use</div>",
    "paragraphs in the body": "<h1 data-gold=1>{h}</h1><p data-gold=1>{p}</p><p data-gold=1>{s}</p><p data-gold=1>{p}</p>",
    "paragraphs and links": "{l} {l} {l}<hr><h1 data-gold=1>{h}</h1><p data-gold=1>{p}</p><p data-gold=1>{p}</p><hr>{l} {l}",
    "table": "<table><tr><td colspan=2>{w}</td></tr><tr><td>{l}<br>{l}<br>{l}<br>{l}</td><td data-gold=1><b>{h}</b><p>{p}<p>{p}<p>{p}</td></tr><tr><td colspan=2>&copy; 2003 {w}</td></tr></table>",
    "table, nested": "<table><tr><td><table><tr><td>{l}</td></tr><tr><td>{l}</td></tr><tr><td>{l}</td></tr></table></td><td><table><tr><td data-gold=1>{h}</td></tr><tr><td data-gold=1>{p}</td></tr><tr><td data-gold=1>{p}</td></tr></table></td>"
                     "<td><font size=1>Buy now: {w}</font></td></tr></table>",
    "forum": "<div class='toolbar'>{l} {l}</div><div class='thread'><h1 data-gold=1>{h}</h1><div class='post' data-gold=1><div>{p}</div></div><div class='replies'><div class='reply'>{s}</div><div class='reply'>{s} {s}</div></div></div>"
             "<form>Reply<textarea>{s}</textarea><button>Send</button></form><div>{l} {l} Powered by a board</div>",
    "documentation": "<nav class='toc'>{m}{m}</nav><main><section data-gold=1><h1>{h}</h1><p>{p}</p><pre>x = 1\ny = call(x)</pre><h2>{w}</h2><p>{p}</p><ul><li>{s}</li><li>{s}</li></ul></section><div>{l} {l}</div></main><footer>{l}</footer>",
    "documentation, divs": "<div class='sphinxsidebar'>{m}</div><div class='document'><div class='body' data-gold=1><h1>{h}</h1><p>{s}</p><dl><dt>{w}</dt><dd><p>{p}</p></dd></dl><p>{p}</p></div></div><div class='related'>{l} {l}</div>",
    "main": "<aside class='notice'><p>{s}</p></aside><nav>{m}</nav><main data-gold=1><h1>{h}</h1><p>{p}</p><p>{w}.</p><pre>x = 1</pre><p>{p}</p></main><aside><h2>{w}</h2><p>{s}</p></aside><form><p>Search</p><div>{w}</div></form><div class='ad'>{s}</div><footer>{w}. All rights reserved.</footer>",
    "comments as articles": "<div class='banner'><p>Sale: everything must go.</p></div><nav>{m}</nav><article data-gold=1><h1>{h}</h1><p>{p}</p><p>{w}.</p><p>{p}</p></article><section class='comments'><h2>Comments</h2>"
                            "<article class='comment'><p>{s}</p></article><article class='comment'><p>{s} {s}</p></article></section><footer><p>{w}</p></footer>",
    "article, long": "<nav>{m}</nav><div class='ad'>{s} {s} {s}</div><article data-gold=1><h1>{s}</h1>" + "<p>{p}</p>" * 12 + "</article><footer>&copy; example.com &middot; {s}</footer>",
    "article, many short": "<nav>{m}</nav><div class='ad'>{s}</div><article data-gold=1><h1>{s}</h1>" + "<p>{s}</p>" * 25 + "</article><footer>&copy; example.com &middot; {s}</footer>",
    "article, one paragraph": "<nav>{m}</nav><article data-gold=1><p>{s} {s}</p></article><footer>{w}</footer>",
    "article alone": "<article data-gold=1><h1>{w}</h1><p>{s}</p></article>",
    "article, everything beside": "<header>{w}</header><nav>{m}</nav><aside class='notice'>{s}</aside><article data-gold=1><h1>{s}</h1><p>{s}</p><ul><li>{s}</li><li>{w}</li></ul><p>{p}</p></article>"
                                  "<section class='comments'><p>{s}</p><p>{p}</p></section><form><p>{s}</p></form><aside class='sidebar'><p>{p}</p></aside><div class='ad'>{p}</div><footer>{p}</footer>",
    "menu and paragraphs": "<nav>{m}</nav><p>{l}</p><p data-gold=1>{s} {s}</p><p data-gold=1>{s} {s}</p>",
    "menu and divs": "<div>{l} {l}</div><div data-gold=1>{p}</div><div data-gold=1>{p}</div>",
    "divs, many": "<div>{w}</div><div>{l} {l}</div>" + "<div data-gold=1>{p}</div>" * 7,
    "divs in a div": "<div data-gold=1>" + "<div>{p}</div>" * 5 + "</div><div>{l} {l} {l}</div>",
    "paragraphs": "<p data-gold=1>{p}<p data-gold=1>{p}<p data-gold=1>{p}<p data-gold=1>{s}<hr>{w}",
    "one sentence": "<div data-gold=1>{s}</div>",
    "plain text": "<div data-gold=1>{p} {p}</div>",
}
#: Layouts that no weight has seen.  Some training layouts were added after looking at the errors on
#: these, so figures on them flatter the model; ``UNTOUCHED`` was written last and scored once.
HELD_OUT = {
    "magazine": "<div id='masthead'>{w}</div><ul>" + "<li>{l}</li>" * 5 + "</ul><div class='col-8'><h2 data-gold=1>{h}</h2><div data-gold=1><p>{p}</p><p>{p}</p><p>{s}</p></div><div class='author'>{l}</div></div>"
                "<div class='col-4'><h4>{w}</h4>{m}<div class='promo'>{s}</div></div><div id='colophon'>&copy; {w} {l} {l}</div>",
    "letter": "<center><h3 data-gold=1>{h}</h3></center><p data-gold=1>{p}<p data-gold=1>{p}<p data-gold=1>{s}<hr><address>Contact: {w}</address>",
    "shop": "<header>{l} {l} {l}</header><section data-gold=1><h1>{h}</h1><p>{p}</p><ul><li>{s}</li><li>{s}</li></ul></section><section><h3>You may also like</h3><div>{l}</div><div>{l}</div></section>"
            "<section class='reviews'><h3>Reviews</h3><p>{s}</p></section><footer><div>{l}</div><div>Subscribe to our newsletter</div></footer>",
    "wiki": "<div id='mw-panel'>{m}{m}</div><div id='bodyContent'><h1 data-gold=1>{h}</h1><div data-gold=1><p>{p}</p><h2>{w}</h2><p>{p} <a href='/x'>{w}</a> {s}</p><p>{p}</p></div></div><div>{l} {l} {l} Privacy policy</div>",
    "divs, long": "<div><div>{w}</div></div><div>" + "<div data-gold=1>{p}</div>" * 9 + "</div><div>{l} {l} {l}</div>",
    "old table": "<table><tr><td bgcolor=red>{l} {l} {l} {l} {l}</td></tr><tr><td data-gold=1><h2>{h}</h2>{p}<br><br>{p}<br>{s}</td></tr><tr><td>Copyright {w}</td></tr></table>",
    "questions": "<nav>{m}</nav><div class='q' data-gold=1><h1>{h}</h1><p>{p}</p></div><div class='a' data-gold=1><p>{p}</p><p>{s}</p></div><ul class='comment-list'><li>{s}</li><li>{s}</li></ul><aside>{m}</aside><footer>{l} {l}</footer>",
    "text": "{w}: <div data-gold=1>{p}</div><div data-gold=1>{p} {p}</div>",
}

UNTOUCHED = {
    "press release": "<div><img src='x.png'> {w}</div><h2 data-gold=1>{h}</h2><div data-gold=1><p>{p}</p><p>{p}</p></div><div>Press contact: {w}, {w}</div><div>{l} {l} {l}</div>",
    "lyrics": "<nav>{m}</nav><main><h1 data-gold=1>{h}</h1><pre data-gold=1>{s}\n{s}\n{s}\n{s}</pre></main><footer>{l}</footer>",
    "definition list": "<div class='nav'>{m}</div><dl data-gold=1><dt>{w}</dt><dd>{p}</dd><dt>{w}</dt><dd>{p}</dd></dl><div class='copyright'>{w}</div>",
    "cards before": "<header>{w}</header><div class='teasers'><div>{l}</div><div>{l}</div><div>{l}</div></div><section data-gold=1><h2>{h}</h2><p>{p}</p><p>{p}</p><p>{p}</p></section><div class='newsletter-box'><p>{s}</p></div>",
    "mail archive": "<table><tr><td>{l} {l} {l}</td></tr></table><h3 data-gold=1>{h}</h3><blockquote data-gold=1>{p}</blockquote><p data-gold=1>{p}</p><hr><p>{l} {l}</p>",
    "frames of divs": "<div><div><div>{l}{l}{l}</div></div></div><div><div><div data-gold=1>{p}</div><div data-gold=1>{p}</div></div><div><div>{l}</div><div>{l}</div></div></div>",
}


def _filled(layout: str, draw: random.Random) -> str:
    def text(least: int, most: int) -> str:
        return " ".join(draw.choices(SENTENCES, k=draw.randint(least, most)))

    def link() -> str:
        return f"<a href='/{draw.randrange(999)}'>{draw.choice(LABELS)}</a>"

    make = {
        "{h}": lambda: draw.choice(HEADINGS), "{p}": lambda: text(1, draw.choice([2, 4, 9])), "{s}": lambda: text(1, 1),
        "{w}": lambda: draw.choice(LABELS), "{l}": link, "{m}": lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(draw.randint(2, 7))) + "</ul>",
    }
    return "<html><body>" + re.sub(r"\{[hpswlm]\}", lambda m: make[m[0]](), layout) + "</body></html>"


def without_names(page: str) -> str:
    """The page without class names, ids, and elements that say what they hold."""
    page = re.sub(r" (?:class|id)='[^']*'", "", page)
    return re.sub(r"(</?)(?:article|section|main|aside|nav|header|footer)(?=[\s>])", r"\1div", page)


def _pages(layouts: dict[str, str], each: int, seed: int) -> list[tuple[str, str]]:
    draw, out = random.Random(seed), []
    for name, layout in layouts.items():
        for i in range(each):
            page = _filled(layout, draw)
            out.append((name, without_names(page) if i % 3 == 2 and name != "article, heading alone" else page))
    return out


def training_pages(each: int = 5) -> list[str]:
    return [page for _, page in _pages(LAYOUTS, each, 1)]


def held_out_pages(each: int = 9) -> list[tuple[str, str]]:
    """(layout, page) of layouts that are not trained on."""
    return _pages(HELD_OUT, each, 2)


def untouched_pages(each: int = 9) -> list[tuple[str, str]]:
    """(layout, page) of layouts that neither training nor its choice of layouts has seen."""
    return _pages(UNTOUCHED, each, 3)
