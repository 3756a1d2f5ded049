"""Labelled web pages that the block labeller is trained on, drawn from layouts by a seed.

A page is put together from regions whose role is known, so each block has its
label by construction. Names of elements and classes are drawn from the usual
ones of a role or left out, regions nest in wrappers with names that say
nothing, and running text is made of invented words, so that what a model can
learn are paths, phrases, links, lengths and what stands before and after.
"""

from __future__ import annotations

import random

MAIN, REST = "\ue000", "\ue001"  # private-use marks before each text; they are taken out again

# Roles: elements, names, phrases that occur in them.
ROLES = {
    "nav": ("nav nav div ul", "nav menu navbar navigation breadcrumb breadcrumbs topbar links tabs pagination pager toc mainmenu", "Home|About|Contact|Next|Previous|Menu|Archive|Categories|Products|Blog|Sign in|Skip to content"),
    "header": ("header header div", "header masthead banner branding logo top site-title hero topbar", "Welcome to|The online magazine|Search|Log in|Subscribe"),
    "footer": ("footer footer div", "footer bottom copyright colophon legal foot credits", "&copy; 2021|&copy;|© 2024|All rights reserved.|Privacy policy|Terms of use|Imprint|Powered by|&middot; Contact"),
    "side": ("aside aside div section", "sidebar side aside widget rail secondary column-right related trending popular recommended more-stories", "Related articles|Read more|Most popular|Recent posts|Trending now|Tags|You may also like"),
    "notice": ("div section dialog aside", "cookie consent notice gdpr alert popup modal overlay paywall newsletter message announcement cookie-banner privacy hidden", "We use cookies to improve your experience.|Accept all|This site uses cookies.|Subscribe to our newsletter|Sign up for free|You have 3 free articles left.|JavaScript is disabled."),
    "ad": ("div div aside section", "ad ads advert advertisement sponsor sponsored promo promotion adsense ad-slot adbox commercial", "Advertisement|Sponsored|Buy now|Special offer|Save 50% today|Order now"),
    "form": ("form form div", "search login signup contact subscribe form search-form comment-form", "Your name|E-mail|Password|Send|Search|Submit|Leave a reply|Message"),
    "comments": ("section section div ol", "comments comment discussion replies reply respond thread responses reader-comments disqus commentlist feedback", "Comments|3 comments|Leave a comment|Reply|Report|Posted by|says:|2 hours ago|Log in to comment|Anonymous"),
    "share": ("div ul section", "share social tools sharing social-links share-buttons follow", "Share|Tweet|Print|E-mail this|Follow us|Copy link"),
}
MAIN_ELEMENTS = "article article article main main div div section".split()
MAIN_NAMES = "article content main post entry body story text page article-body entry-content post-content markdown maincontent prose blog-post news".split()
NOISE = "row col-6 wrap wrapper container inner outer grid flex box block item css-1abc x3f2a clearfix section module layer left right group unit".split()
SYLLABLES = "an be ca do el fi gra ho in jo ka le mo né or pa qui ra so ta un ver wi xa yo zu ch str th ei sch ción äu ß".split()

COMMON = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her would there their we him been has when who will no more if out so up "
    "what my than about into them can only other time new some could these two may first then do any like our such your le la les de des et en un une du que qui pour dans est sur pas au il elle avec ce par "
    "der die das und ist ein eine zu den von mit für auf im nicht sich auch es el los las y por con para se su al como más pero"
).split()
PHRASED = [w for _, _, phrases in ROLES.values() for w in phrases.replace("|", " ").split() if w.isalpha()]


class Layouts:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    # text

    def word(self) -> str:
        x = self.r.random()
        if x < 0.3:
            return self.r.choice(COMMON if x < 0.26 else PHRASED)
        return "".join(self.r.choices(SYLLABLES, k=self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def sentences(self, n: int) -> str:
        out, shape = [], self.r.random()
        while n > 0:
            k = min(n, self.r.randint(1, 14))
            odd = self.r.choice(("&amp;&amp;", "%%%", "***", "###")) if shape < 0.05 else ""
            out.append(" ".join(w + odd for w in self.words(k).capitalize().split()) + ("," if self.r.random() < 0.1 else "") + self.r.choice("......?!:"))
            n -= k
        return " ".join(out)

    def prose(self, most: int = 120) -> str:
        """Text with markup within lines."""
        out = []
        for part in self.sentences(int(self.r.triangular(1, most, 12))).split(" "):
            x = self.r.random()
            if x < 0.015:
                part = f'<a href="/{self.word()}">{part}</a>'
            elif x < 0.03:
                part = self.r.choice(("<b>{}</b>", "<em>{}</em>", "<span class=x>{}</span>", "{}<br>", "<code>{}</code>", "{}<sup>1</sup>")).format(part)
            out.append(part)
        return " ".join(out)

    # elements

    def attributes(self, names: list[str], named: float) -> str:
        r, out = self.r, []
        if r.random() < named:
            name = r.choice(names)
            if r.random() < 0.3:
                name = r.choice(("main-{}", "site-{}", "{}-inner", "{}__list", "{}-2", "page-{}", "{}_box", "js-{}", "{}Area")).format(name if r.random() < 0.7 else name.capitalize())
            if r.random() < 0.3:
                name = f"{r.choice(NOISE)} {name}" if r.random() < 0.5 else f"{name} {r.choice(NOISE)}"
            out.append(r.choice(('class="{}"', 'class="{}"', 'id="{}"', "class={}" if " " not in name else "class='{}'")).format(name))
        elif r.random() < 0.4:
            out.append(f'class="{r.choice(NOISE)}"')
        if r.random() < 0.05:
            out.append(f'data-x="{r.randint(0, 99)} > 3"')
        return "".join(" " + a for a in out)

    def wrapped(self, inner: str) -> str:
        for _ in range(self.r.choice((0, 0, 0, 1, 1, 2))):
            inner = f"<div{self.attributes(NOISE, 0.7)}>{inner}</div>"
        return inner

    def links(self, mark: str, phrases: list[str]) -> str:
        r, out = self.r, []
        shape = r.choice(("<li><a href='/x'>{}</a></li>", "<li><a href='/x'>{}</a></li>", "<li><a href=/x>{}</a>", "<a href='/x'>{}</a> ", "<div><a href='/x'>{}</a></div>", "<p><a href='/x'>{}</a></p>", "<a href='/x'>{}</a> | "))
        for _ in range(r.randint(2, 9)):
            text = r.choice(phrases) if phrases and r.random() < 0.3 else self.words(r.choice((1, 1, 1, 2, 2, 3, 5, 8)))
            out.append(shape.format(mark + (text.capitalize() if r.random() < 0.5 else text + r.choice(("", "", ".", ",")))))
        return f"<ul>{''.join(out)}</ul>" if shape.startswith("<li") else "".join(out)

    def role(self, kind: str) -> str:
        r = self.r
        elements, names, phrases = ROLES[kind]
        tag, names, phrases = r.choice(elements.split()), names.split(), phrases.split("|")
        phrase = lambda: REST + (r.choice(phrases) + (" " + self.words(r.randint(0, 6)) if r.random() < 0.4 else "") if r.random() < 0.6 else self.sentences(r.randint(1, 12)))
        some = lambda low, high: "".join(f"<{t}>{phrase()}</{t}>" for t in [r.choice(("p", "div", "p", "h3", "h4")) for _ in range(r.randint(low, high))])
        if kind in ("nav", "share"):
            inner = self.links(REST, phrases)
        elif kind == "header":
            inner = (f"<h1>{REST}{self.words(r.randint(1, 4))}</h1>" if r.random() < 0.5 else f"<div>{phrase()}</div>") + (some(0, 1)) + (self.role("nav") if r.random() < 0.4 else "") + (self.role("form") if r.random() < 0.15 else "")
        elif kind == "footer":
            mid = " &middot; " + self.sentences(r.randint(1, 8)) if r.random() < 0.4 else ""
            inner = f"{REST}{r.choice(('&copy;', '©', '&copy; 2023'))} {self.word()}.example.com{mid}" if r.random() < 0.5 else some(1, 3)
            inner += self.links(REST, phrases) if r.random() < 0.4 else ""
        elif kind == "side":
            inner = "".join(f"<h3>{phrase()}</h3>" + (self.links(REST, phrases) if r.random() < 0.6 else f"<p>{REST}{self.prose(40)}</p>") for _ in range(r.randint(1, 3)))
        elif kind == "form":
            inner = "".join(r.choice(("<label>{}</label><input name=a><br>", "<p>{} <input name=q></p>", "<div><label>{}</label> <textarea>x</textarea></div>", "<button>{}</button>", "<select><option>{}</select>")).format(phrase()) for _ in range(r.randint(1, 4)))
        elif kind == "comments":
            item, name = r.choice(("div", "li", "article", "div")), r.choice(("comment", "reply", "comment-body", "response", "")) if names else ""
            one = lambda: f"<{item}{f' class={name}' if name else ''}><{'p'} class=author>{REST}{self.words(r.randint(1, 2))}{r.choice((' says:', '', ', 2 hours ago'))}</p><p>{REST}{self.prose(60)}</p>{f'<a href=#>{REST}Reply</a>' if r.random() < 0.3 else ''}</{item}>"
            inner = (f"<h2>{phrase()}</h2>" if r.random() < 0.7 else "") + "".join(one() for _ in range(r.randint(1, 5))) + (self.role("form") if r.random() < 0.3 else "")
        elif kind == "ad":
            inner = phrase() if r.random() < 0.6 else some(1, 2)
        else:
            inner = phrase() + (f" <button>{REST}{r.choice(('Accept', 'OK', 'Close'))}</button>" if r.random() < 0.4 else "") if r.random() < 0.6 else some(1, 3)
        if tag == "ul" and "<li" not in inner or tag == "ol" and "<li" not in inner:
            tag = "div"
        named = 0.75 if tag in ("nav", "header", "footer", "form", "aside") else 0.85 if kind in ("nav", "footer", "header") else 1.0
        return self.wrapped(f"<{tag}{self.attributes(names, named)}>{inner}</{tag}>")

    def odd_line(self) -> str:
        """A line of main text that looks like something else: cells, notes of rights, phrases of other regions, numbers, a word."""
        r = self.r
        phrases = ROLES[r.choice([*ROLES])][2].split("|")
        return r.choice((
            lambda: " | ".join(self.words(1) for _ in range(r.randint(1, 6))) + r.choice(("", " |", ".")), lambda: f"{self.words(r.randint(1, 3))}: {r.randint(0, 999)} {self.word()}",
            lambda: r.choice(("Licensed under CC BY {}.", "Copyright {} by the authors.", "All rights reserved {}.", "Published under the MIT licence {}.")).format(r.randint(1, 4)),
            lambda: r.choice(phrases), lambda: f"{r.choice(phrases)} {self.words(r.randint(1, 5))}", lambda: self.word().capitalize() + r.choice(("", ".", "!")), lambda: " ".join(str(r.randint(0, 10**r.randint(1, 6))) for _ in range(r.randint(1, 8))),
            lambda: f"{self.word()}@{self.word()}.example.com, +{r.randint(10, 99)} {r.randint(1000, 9999999)}", lambda: r.choice("$#%&*=+-~") * r.randint(1, 30), lambda: f"<a href=/x>{self.words(r.randint(1, 5))}</a>",
        ))()

    def article(self) -> str:
        """Blocks of the main text, with a few foreign regions between them."""
        r, out = self.r, []
        if r.random() < 0.65:
            head = f"<h1>{MAIN}{self.words(r.randint(2, 12)).capitalize()}</h1>"
            out.append(f"<header>{head}</header>" if r.random() < 0.08 else head)
        broken, bare = r.random() < 0.2, r.random() < 0.1
        tag = "" if r.random() < 0.05 else r.choice(MAIN_ELEMENTS)
        names = self.attributes(MAIN_NAMES, 0.5 if tag in ("article", "main") else 0.9)
        told = tag in ("article", "main") or any(n in names.lower() for n in MAIN_NAMES)  # there, odd lines can be known for main text
        odd = r.choice((0, 0.03, 0.1, 0.3)) if told else 0
        again = f"<p>{MAIN}{self.sentences(r.randint(1, 5))}</p>"  # a line that repeats
        repeats, most = (r.choice((0, 0, 0.2, 0.6)), r.choice((120, 120, 30, 6))) if told else (0, 120)
        for i in range(r.choice((1, 1, 2, 2, 3, 4, 5, 6, 8, 10, 14, 20, 50 if told else 20))):
            if r.random() < repeats:
                out.append(again * r.choice((1, 1, 1, 2, 3, 6)))
                continue
            x = r.random()
            if x < 0.62:
                text = MAIN + (self.odd_line() if r.random() < odd else self.prose(most))
                out.append(f"<p>{text}" if broken and r.random() < 0.5 else f"<div>{text}</div>" if bare else f"<p>{text}</p>")
            elif x < 0.72:
                out.append(f"<h{r.choice('234')}>{MAIN}{self.words(r.randint(1, 7)).capitalize()}</h2>" if r.random() < 0.5 else f"<p><b>{MAIN}{self.sentences(r.randint(1, 12))}<br>")
            elif x < 0.79:
                tag = r.choice(("ul", "ol"))
                out.append(f"<{tag}>{''.join(f'<li>{MAIN}{self.prose(25)}</li>' for _ in range(r.randint(1, 6)))}</{tag}>")
            elif x < 0.83:
                out.append(f"<blockquote><p>{MAIN}{self.prose(60)}</p></blockquote>")
            elif x < 0.86:
                out.append(f"<figure><img src=a.png alt='x'><figcaption>{MAIN}{self.prose(20)}</figcaption></figure>")
            elif x < 0.89:
                rows = "".join("<tr>" + "".join(f"<td>{MAIN}{self.words(r.randint(1, 3))}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 4)))
                out.append(f"<table>{rows}</table>")
            elif x < 0.91:
                out.append(f"<pre>{MAIN}{self.words(r.randint(1, 20))}\n  {self.words(4)}</pre>")
            elif x < 0.95 and i:
                out.append(self.role(r.choice(("ad", "ad", "side", "notice", "share", "form"))))
        if not any(MAIN in x for x in out):
            out.append(f"<p>{MAIN}{self.prose()}</p>")
        if r.random() < 0.12:
            out.append(self.role(r.choice(("share", "comments", "side"))))
        inner = "\n".join(out) if r.random() < 0.5 else "".join(out)
        return self.wrapped(f"<{tag}{names}>{inner}</{tag}>") if tag else inner

    def page(self) -> str:
        r = self.r
        alone = r.random() < 0.2  # nothing but the main text
        some = lambda kind, share: self.role(kind) if not alone and r.random() < share else ""
        before = [some("notice", 0.2), some("header", 0.45), some("nav", 0.7), "<!-- ad 3 -->", some("ad", 0.4), some("form", 0.08)]
        main, side = self.article() if r.random() < 0.97 else "", some("side", 0.35)
        if r.random() < 0.04:
            middle = f"<table><tr><td>{self.links(REST, [])}</td><td>{main}</td></tr></table>"
        else:
            middle = self.wrapped(side + main if r.random() < 0.3 else main + side)
        after = [some("share", 0.12), some("comments", 0.3), some("ad", 0.15), some("form", 0.1), some("nav", 0.1), some("footer", 0.75), some("notice", 0.2)]
        style, script = "<style>p{margin:0}</style>", '<script>var t="</p>";</script>'
        body = "".join(before) + middle + "".join(after)
        end = "</body></html>" if r.random() < 0.85 else ""
        return f"<!DOCTYPE html><html lang=en><head><meta charset=utf-8><title>{self.words(4)}</title>{style}{script}</head><body{self.attributes(NOISE, 0.3)}>{body}{end}"
