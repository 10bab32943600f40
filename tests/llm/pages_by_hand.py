"""Pages written by hand in the manner of different site builders, apart from the generator that the extractor learns
from. Each is (html, main text)."""

A = "Engineers opened the new bridge over the estuary on Monday, two years after work on its foundations began."
B = "The crossing is 1.2 km long, carries four lanes and a footway, and replaces a ferry that ran for almost a century."
C = "Local shops expect more visitors, though some residents fear that traffic will grow in the narrow streets of the old town."
D = "\"We have waited for this day for a long time\", said the mayor at the opening."
K = "Thanks, that was an interesting read! I used to take the ferry every day and will miss it a lot."
L = "I disagree completely. Nobody asked us whether we wanted this bridge in the first place."
LINKS = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/about">About us</a></li></ul>'
FOOT = "<p>© 2024 The Estuary Times. All rights reserved. <a href='/imprint'>Imprint</a> <a href='/privacy'>Privacy</a></p>"


def head(title: str) -> str:
    return f"<!doctype html><html lang=en><head><meta charset=utf-8><title>{title}</title><script>var a='<p>no</p>';</script><style>.x{{}}</style></head>"


BLOG = f"""{head("Bridge")}<body class="post-template single"><div id="page" class="hfeed site"><header id="masthead" class="site-header"><p class="site-title"><a href="/">The Estuary Times</a></p>
<nav id="site-navigation" class="main-navigation">{LINKS}</nav></header><div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main">
<article id="post-12" class="post type-post"><header class="entry-header"><h1 class="entry-title">A bridge opens</h1></header><div class="entry-content"><p>{A}</p><p>{B}</p><blockquote><p>{D}</p></blockquote><p>{C}</p></div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts</h2><ol class="comment-list"><li class="comment"><div class="comment-body"><p>{K}</p></div></li><li class="comment"><div class="comment-body"><p>{L}</p></div></li></ol>
<div id="respond" class="comment-respond"><h3>Leave a reply</h3><form><label>Name</label><input name=a><button>Post</button></form></div></div></main></div>
<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/a">Harvest fair</a></li><li><a href="/b">School to close</a></li></ul></section></aside></div>
<footer id="colophon" class="site-footer">{FOOT}</footer></div></body></html>"""

GRID = f"""{head("Bridge")}<body><div class="navbar navbar-expand"><div class="container">{LINKS}</div></div><div class="container"><div class="row"><div class="col-md-8"><h1>A bridge opens</h1><p>{A}</p>
<p>{B}</p><h2>What people say</h2><p>{D}</p><p>{C}</p></div><div class="col-md-4 sidebar"><div class="card"><h5>Popular</h5><a href="/p">Ten walks by the river</a></div></div></div></div><div class="footer"><div class="container">{FOOT}</div></div></body></html>"""

SEMANTIC = f"""{head("Bridge")}<body><header><h1>The Estuary Times</h1><nav>{LINKS}</nav></header><main><article><h2>A bridge opens</h2><p>{A}<p>{B}<ul><li>Length: 1.2 km</li><li>Lanes: four</li></ul><p>{C}</article>
</main><aside><h3>More</h3><p>Subscribe to our newsletter for the latest from the region.</p></aside><footer>{FOOT}</footer></body></html>"""

NESTED = f"""{head("Bridge")}<body><div><div><div>{LINKS}</div></div><div><div><div><div><article><div><div><div><h1>A bridge opens</h1><div><p>{A}</p></div><div><p>{B}</p></div><div><p>{C}</p></div></div></div></div></article></div></div></div></div>
<footer><div><div>{FOOT}</div></div></footer></div></body></html>"""

TABLES = f"""<html><body><table width="100%"><tr><td colspan=2 class="banner"><a href="/">The Estuary Times</a></td></tr><tr><td class="menu" valign=top>{LINKS}</td><td class="content" valign=top><h1>A bridge opens</h1>
<p>{A}</p><p>{B}</p><p>{C}</p></td></tr><tr><td colspan=2 class="footer">{FOOT}</td></tr></table></body></html>"""

ROLES = f"""{head("Bridge")}<body><div role="banner">The Estuary Times</div><div role="navigation">{LINKS}</div><div role="main"><h1>A bridge opens</h1><p>{A}</p><div class="ad-slot">Advertisement: buy two, get one free</div><p>{B}</p><p>{C}</p></div>
<div role="complementary" class="related"><h3>Related</h3><p>How the ferry came to an end</p></div><div role="contentinfo">{FOOT}</div></body></html>"""

COOKIES = f"""{head("Bridge")}<body><div class="cookie-banner"><p>We use cookies to improve your experience. By continuing you agree to our policy.</p><button>Accept</button></div><div id="header"><a href="/">The Estuary Times</a></div><div id="nav">{LINKS}</div>
<div id="article-body"><h1>A bridge opens</h1><p>{A}</p><p>{B}</p><div class="newsletter-signup"><p>Get our best stories in your inbox.</p><form><input><button>Sign up</button></form></div><p>{C}</p></div>
<div class="share"><a href="#">Share</a> <a href="#">Tweet</a></div><div id="disqus_thread" class="comments"><p>{K}</p><p>{L}</p></div><div id="footer">{FOOT}</div></body></html>"""

DOCS = f"""{head("Install")}<body><nav class="sidebar-nav"><ul><li><a href="/i">Install</a></li><li><a href="/u">Use</a></li></ul></nav><div class="document"><div class="body" role="main"><section id="install"><h1>Install</h1><p>Fetch the archive and unpack it.</p>
<pre>tar xf tool.tgz &amp;&amp; cd tool</pre><p>Then run the setup, which asks where to put its files and needs about a minute.</p></section></div></div><div class="footer">Built with a site generator.</div></body></html>"""

PLAIN = f"<html><body><h1>A bridge opens</h1><p>{A}</p><p>{B}</p><p>{C}</p><hr><p class=copyright>© 2024 The Estuary Times</p></body></html>"

SECTIONS = f"""{head("Bridge")}<body><section class="topbar">{LINKS}</section><section><div class="inner"><div class="story"><h1>A bridge opens</h1><p>{A} <a href="/map">See the map</a> {B}</p><p>{D}</p><p>{C}</p></div></div></section><section class="most-read"><h3>Most read</h3><ol><li><a href="/1">Storm ahead</a></li><li><a href="/2">Cup final</a></li></ol></section><section class="legal">{FOOT}</section></body></html>"""


def joined(*parts: str) -> str:
    return " ".join(("A bridge opens", *parts))


PAGES = [
    (BLOG, joined(A, B, D, C)),
    (GRID, joined(A, B, "What people say", D, C)),
    (SEMANTIC, joined(A, B, "Length: 1.2 km", "Lanes: four", C)),
    (NESTED, joined(A, B, C)),
    (TABLES, joined(A, B, C)),
    (ROLES, joined(A, B, C)),
    (COOKIES, joined(A, B, C)),
    (DOCS, "Install Fetch the archive and unpack it. tar xf tool.tgz && cd tool Then run the setup, which asks where to put its files and needs about a minute."),
    (PLAIN, joined(A, B, C)),
    (SECTIONS, joined(f"{A} See the map {B}", D, C)),
]

#: Pages whose names say nothing, or in other languages, and pages of hardly any markup.
E = "The harbour office had warned that fog might delay the first lorries, but by noon the queue on the eastern bank was gone."
G = "For the winter the council plans extra salt depots on both sides, since the deck freezes earlier than the roads around it."
T = "A bridge opens"


def page(body: str, title: str = "Bridge") -> str:
    return f"{head(title)}<body>{body}</body></html>"


NAMELESS = [
    (page(f"<div><div><a href='/'>Home</a></div><div><a href='/n'>News</a></div></div><div><div>{T}</div><div>{A}</div><div>{B}</div><div>{C}</div></div><div><div>© 2024 The Estuary Times</div></div>"), joined(A, B, C)),
    (page(f"<div><div>{T}</div><div>{A}</div><div>{B}</div><div>{C}</div></div>"), joined(A, B, C)),
    (page(f"<div>{LINKS}</div><div><span>{A}</span><br><br><span>{B}</span><br><br><span>{C}</span></div><div>{FOOT}</div>"), f"{A} {B} {C}"),
    (page(f"{A}<br><br>{B}<br><br>{C}"), f"{A} {B} {C}"),
    (f"{A}\n\n{B}\n\n{C}", f"{A} {B} {C}"),
    (page(f"<nav>{LINKS}</nav><article><h1>{T}</h1><p>{A}</p><p>{B}</p><h2>Sources</h2><ul><li><a href='/1'>Port authority report</a></li><li><a href='/2'>Council minutes</a></li></ul></article><footer>{FOOT}</footer>"), joined(A, B, "Sources Port authority report Council minutes")),
    (page(f"<nav>{LINKS}</nav><article><h1>{T}</h1><p>{A}</p><p>{B}</p></article><section id='replies'><h3>Replies</h3><div><p>{K}</p></div><div><p>{L}</p></div></section>"), joined(A, B)),
    (page(f"<div class='kopfzeile'>Die Zeitung</div><div class='inhalt'><h1>{T}</h1><p>{A}</p><p>{B}</p></div><div class='kommentare'><h3>Kommentare</h3><p>{K}</p><p>{L}</p></div><div class='fusszeile'><p>Alle Rechte vorbehalten, Verlag der Zeitung am Fluss.</p></div>"), joined(A, B)),
    (page(f"<div class='x1 css-9af'><div class='x2'>{LINKS}</div><div class='x7'><div class='css-1q'><h1>{T}</h1><div class='css-2b'>{A}</div><div class='css-2b'>{B}</div><div class='css-2b'>{E}</div></div></div><div class='x9'>© 2024 The Estuary Times</div></div>"), joined(A, B, E)),
    (page(f"<div class='entete'><a href='/'>Le Journal</a></div><div class='navegacion'>{LINKS}</div><div class='texte'><h1>{T}</h1><p>{A}</p><p>{G}</p></div><div class='commentaires'><p>{K}</p></div><div class='pie-de-pagina'><p>Todos los derechos reservados por el periódico.</p></div>"), joined(A, G)),
    (page(f"<center><font size=5>{T}</font></center><hr><font>{A}</font><p><font>{B}</font><p><font>{G}</font><hr><a href='/'>Back to the list</a>"), joined(A, B, G)),
    (page(f"<table><tr><td>{LINKS}</td><td><h1>{T}</h1><div>{A}</div><div>{E}</div><div>{C}</div></td></tr><tr><td colspan=2>{FOOT}</td></tr></table>"), joined(A, E, C)),
    (page(f"<section><ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li></ul></section><section><h1>{T}</h1><p>{A}</p><h2>Before the winter</h2><p>{G}</p><p>{E}</p></section><section>{FOOT}</section>"), joined(A, "Before the winter", G, E)),
    (page(f"<main><h1>{T}</h1><p>{A}</p><aside><p>Ten walks by the river that everybody should know about this summer.</p></aside><p>{B}</p><div class='kommentar'><p>{L}</p></div></main>"), joined(A, B)),
    (page(f"<div><h1>{T}</h1><blockquote>{D}</blockquote><p>{A}</p><ol><li>{B}</li><li>{G}</li></ol></div>"), joined(D, A, B, G)),
    (page(f"<div id='cookie-consent'>{'We use cookies and similar techniques on this site to improve it. '}<button>OK</button></div><div><div><div><h1>{T}</h1><div>{A}</div><div>{E}</div></div></div></div>"), joined(A, E)),
    (page(f"<div><a href='/'>Home</a> | <a href='/a'>Archive</a> | <a href='/c'>Contact</a></div><h1>{T}</h1>{A}<br>{B}<br>{G}<div>© 2024</div>"), joined(f"{A} {B} {G}")),
    (page(f"<div role='main'><h1>{T}</h1><div>{A}</div><figure><img src=a.png><figcaption>The new bridge at dusk</figcaption></figure><div>{C}</div></div><div role='contentinfo'>{FOOT}</div>"), joined(A, "The new bridge at dusk", C)),
    (f"<p>{A}<p>{B}<p>{E}", f"{A} {B} {E}"),
    (page(f"<article><div><div>{T}</div></div><div><span>{A}</span></div><div><span>{B} <a href='/f'>The ferry</a> {E}</span></div></article><div class='werbung'>Jetzt kaufen und bis zum Ende des Monats sparen.</div>"), joined(A, f"{B} The ferry {E}")),
    (page(f"<form><input><button>Search</button></form><dl><dt>{T}</dt><dd>{A}</dd><dd>{B}</dd><dd>{G}</dd></dl>"), joined(A, B, G)),
    (page(f"<pre>{A}\n\n{B}\n\n{C}</pre>"), f"{A} {B} {C}"),
]
