"""Pages written and labelled by hand, one a layout; ``MAIN`` lines are the blocks of the article."""

PAGES = {
    "newspaper": ("""<!doctype html><html><head><title>Bridge reopens | The Courier</title><meta property="og:type" content="article"></head><body>
<div id="cookie-consent" role="dialog"><p>We and our partners use cookies to store information.</p><button>Accept</button></div>
<header class="site-header"><a href="/">The Courier</a><form><input name=q placeholder=Search></form></header><nav class="main-nav"><a href="/world">World</a> <a href="/local">Local</a> <a href="/sport">Sport</a></nav>
<main><article><h1>Old bridge reopens after two years of repairs</h1><div class="byline">By Anna Field, 3 May</div>
<p>The stone bridge over the river opened to walkers on Monday, two years after a flood had damaged three of its seven arches.</p>
<figure><img src=b.jpg><figcaption>The bridge on Monday morning.</figcaption></figure>
<p>Masons rebuilt the piers with blocks from the same quarry that served the first builders in 1742.</p>
<aside class="related"><h3>Related</h3><ul><li><a href=1>Flood of the century</a></li><li><a href=2>Council votes on budget</a></li></ul></aside>
<h2>What comes next</h2><p>Cars will have to wait until autumn, said the mayor: &ldquo;We want to see how it settles.&rdquo;</p></article></main>
<div class="share-bar"><a>Tweet</a><a>Share</a></div><section id="comments"><h3>2 comments</h3><p>Finally! I walked it today.</p><p>Too expensive if you ask me.</p></section>
<footer><p>&copy; 2024 The Courier. All rights reserved.</p><a href=/imprint>Imprint</a></footer></body></html>""",
        ["Old bridge reopens after two years of repairs", "The stone bridge over the river opened to walkers on Monday, two years after a flood had damaged three of its seven arches.", "The bridge on Monday morning.", "Masons rebuilt the piers with blocks from the same quarry that served the first builders in 1742.", "What comes next", "Cars will have to wait until autumn, said the mayor: “We want to see how it settles.”"]),
    "tables of the nineties": ("""<HTML><HEAD><TITLE>My page about bees</TITLE></HEAD><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD COLSPAN=2><FONT SIZE=1><A HREF=index.html>Home</A> | <A HREF=links.html>Links</A> | <A HREF=guest.html>Guestbook</A></FONT>
<TR><TD WIDTH=120><A HREF=a.html>Honey</A><BR><A HREF=b.html>Wax</A><BR><A HREF=c.html>Hives</A><TD><H1>Keeping bees on a balcony</H1><P>A small hive needs no more than a square metre and some shade at noon.
<P>Open it on warm days only, and never when it rains. The colony will tell you if it is in a bad mood.<P>In winter the bees live on what you left them, so do not take all the honey.</TABLE><HR><CENTER><FONT SIZE=1>Last updated 3/4/98. Copyright 1998 by me.</FONT></CENTER></BODY></HTML>""",
        ["Keeping bees on a balcony", "A small hive needs no more than a square metre and some shade at noon.", "Open it on warm days only, and never when it rains. The colony will tell you if it is in a bad mood.", "In winter the bees live on what you left them, so do not take all the honey."]),
    "documentation": ("""<!DOCTYPE html><html><head><title>Sorting - Guide</title><style>.x{}</style></head><body><div class="toolbar"><a href=/>Docs</a><a href=/api>API</a></div><div class="sidebar"><ul class="toc"><li><a href=#a>Install</a><li><a href=#b>Sort</a><li><a href=#c>Search</a></ul></div>
<div role="main" class="content"><h1>Sorting lists</h1><p>Call <code>sort</code> to order a list in place; it returns nothing.</p><pre>items.sort(key=len)</pre><h2>Stability</h2><p>Equal items keep their order, so several sorts can be chained.</p><ul><li>Sort by the minor key first.</li><li>Then sort by the major key.</li></ul>
<table><tr><th>Case</th><th>Time</th></tr><tr><td>sorted already</td><td>linear</td></tr></table></div><div class="pager"><a href=p>Previous</a> <a href=n>Next</a></div><div class="footer">Built with a generator.</div></body></html>""",
        ["Sorting lists", "Call sort to order a list in place; it returns nothing.", "items.sort(key=len)", "Stability", "Equal items keep their order, so several sorts can be chained.", "Sort by the minor key first.", "Then sort by the major key.", "Case", "Time", "sorted already", "linear"]),
    "generated class names": ("""<!doctype html><html><body><div class="css-19ab"><div class="css-77x"><a class="css-1" href=/>Orbit</a><a class="css-1" href=/m>Magazine</a><a class="css-1" href=/s>Shop</a></div></div>
<div class="css-40"><div class="css-41"><h1 class="css-42">Why the night sky is dark</h1><div class="css-43"><p>If the universe were endless and eternal, every line of sight would end on a star, and the night would be as bright as the day.</p><p>It is not, because light needs time, and there has not been enough of it since the beginning.</p><p>The farthest light we see has also been stretched until our eyes no longer notice it.</p></div></div></div>
<div class="css-88 newsletter-signup"><p>Subscribe to our newsletter</p><input><button>Sign up</button></div><div class="css-90"><a href=/t>Terms</a> <a href=/p>Privacy</a></div></body></html>""",
        ["Why the night sky is dark", "If the universe were endless and eternal, every line of sight would end on a star, and the night would be as bright as the day.", "It is not, because light needs time, and there has not been enough of it since the beginning.", "The farthest light we see has also been stretched until our eyes no longer notice it."]),
    "blog in German": ("""<html lang=de><head><title>Brot</title></head><body><div id=wrapper><div id=header><h1><a href=/>Kruste &amp; Krume</a></h1><div id=nav><ul><li><a href=/>Start</a><li><a href=/about>Über mich</a><li><a href=/impressum>Impressum</a></ul></div></div><div id=main><div class="post"><h2>Sauerteig ohne Eile</h2><div class=meta>4. März von Jana</div><div class=entry><p>Drei Tage lang steht das Glas auf der Heizung, und dreimal am Tag bekommt es einen Löffel Mehl.</p><p>Am vierten Tag riecht es nach Apfel, und der Teig hebt den Deckel von allein.</p><blockquote>Geduld ist die wichtigste Zutat.</blockquote><p>Gebacken wird auf dem Stein, heiß und mit viel Dampf.</p></div></div>
<div id=comments><h3>Kommentare</h3><ol class=commentlist><li><p>Klappt das auch mit Roggen?</p><li><p>Bei mir schimmelt er immer.</p></ol><form><p>Schreib einen Kommentar</p><textarea></textarea></form></div></div><div id=sidebar><h3>Neueste Beiträge</h3><ul><li><a href=1>Brezeln</a><li><a href=2>Pizza</a></ul></div><div id=footer>Alle Rechte vorbehalten</div></div></body></html>""",
        ["Sauerteig ohne Eile", "Drei Tage lang steht das Glas auf der Heizung, und dreimal am Tag bekommt es einen Löffel Mehl.", "Am vierten Tag riecht es nach Apfel, und der Teig hebt den Deckel von allein.", "Geduld ist die wichtigste Zutat.", "Gebacken wird auf dem Stein, heiß und mit viel Dampf."]),
    "recipe with adverts": ("""<html><body><div class="ad-slot">Advertisement</div><ul class="breadcrumbs"><li><a href=/>Home</a><li><a href=/soups>Soups</a></ul><div class="recipe"><h1>Leek and potato soup</h1><p>Ready in forty minutes, and better on the second day.</p><div class="advert">Sponsored: a pan that never sticks. Buy now and save 20%!</div><h2>Ingredients</h2><ul><li>3 leeks</li><li>500 g potatoes</li><li>1 litre of stock</li></ul><h2>Method</h2><ol><li>Slice the leeks and soften them in butter.<li>Add potatoes and stock, and cook until soft.<li>Blend half of it.</ol></div><div class="popular"><h4>Most read</h4><a href=1>Bread</a><a href=2>Cake</a></div><div class="social"><a>Pin it</a></div></body></html>""",
        ["Leek and potato soup", "Ready in forty minutes, and better on the second day.", "Ingredients", "3 leeks", "500 g potatoes", "1 litre of stock", "Method", "Slice the leeks and soften them in butter.", "Add potatoes and stock, and cook until soft.", "Blend half of it."]),
    "encyclopedia": ("""<!DOCTYPE html><html><head><title>Otter</title></head><body class="skin"><div id="mw-page"><h1 id="firstHeading">Otter</h1><div id="bodyContent"><div id="siteSub">From the open encyclopedia</div><p><b>Otters</b> are carnivorous mammals that live in and near water. There are 14 species.</p><h2>Diet</h2><p>Most otters eat fish, but some prefer crayfish, crabs or sea urchins.</p><p>Sea otters open shells with stones that they carry under an arm.<sup><a href=#c1>[1]</a></sup></p></div></div>
<div id="mw-navigation"><h2>Navigation menu</h2><ul><li><a href=/m>Main page</a><li><a href=/r>Random article</a></ul></div><div id="footer"><ul><li>This page was last edited on 1 May.<li><a href=/p>Privacy policy</a></ul></div></body></html>""",
        ["Otter", "Otters are carnivorous mammals that live in and near water. There are 14 species.", "Diet", "Most otters eat fish, but some prefer crayfish, crabs or sea urchins.", "Sea otters open shells with stones that they carry under an arm.[1]"]),
    "plain": ("""<html><body><h1>Notes on a walk</h1>We started at six, when the valley was still grey.<p>By noon the fog had gone and we could see the sea.<p>There is a hut on the pass, but it was closed.<br>We ate our bread in the wind.</body></html>""",
        ["Notes on a walk", "We started at six, when the valley was still grey.", "By noon the fog had gone and we could see the sea.", "There is a hut on the pass, but it was closed. We ate our bread in the wind."]),
}
