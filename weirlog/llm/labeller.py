"""A bidirectional LSTM in numpy that labels the blocks of a page as main text or not.

It reads, for each block, hashed marks of its tag path, hashed words and a few measures of the text,
and sees the whole page from both sides. It is trained on pages made by a small generator of common
layouts; nothing of the input is used, so equal code gives equal weights.
"""

from __future__ import annotations

import random
import zlib
from functools import lru_cache

import numpy as np

from weirlog.llm import texts
from weirlog.llm.html_blocks import blocks
from weirlog.llm.jaccard import word_hashes

PATH, WORDS, MEASURES, HIDDEN = 192, 32, 8, 24
WIDTH = PATH + WORDS + MEASURES
PAGES, EPOCHS, SEED = 900, 14, 7


@lru_cache(maxsize=50_000)
def _path_vector(path: tuple) -> np.ndarray:
    """Marks of the path; those of the two innermost elements count twice, once as such."""
    out = np.zeros(PATH, np.float32)
    for depth, names in enumerate(reversed(path)):
        for name in names:
            h = zlib.crc32(name.encode())
            out[h % 128] += 1.0 if h & 0x10000 else -1.0
            if depth < 2:
                h = zlib.crc32(f"{depth}{name}".encode())
                out[128 + h % 64] += 1.0 if h & 0x10000 else -1.0
    return np.clip(out, -2, 2)


def features(pages: list[list]) -> np.ndarray:
    """One row per block of all pages, one page after another."""
    flat = [b for page in pages for b in page]
    out = np.zeros((len(flat), WIDTH), np.float32)
    if not flat:
        return out
    out[:, :PATH] = np.stack([_path_vector(path) for path, _, _ in flat])
    data = [t.encode() for _, t, _ in flat]
    off = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    raw = np.frombuffer(b"".join(data), np.uint8)
    starts, ends, rows = texts.words(raw, off, texts.table_of(texts.SPACE))
    n = len(flat)
    if len(starts):
        with np.errstate(over="ignore"):
            h = word_hashes(raw, starts, ends)
        slot = (h >> np.uint64(8)) % np.uint64(WORDS)
        sign = np.where(h & np.uint64(1), 1.0, -1.0)
        hashed = np.bincount(rows * WORDS + slot.astype(np.int64), sign, n * WORDS).reshape(n, WORDS)
        norm = np.sqrt((hashed**2).sum(axis=1, keepdims=True))
        out[:, PATH : PATH + WORDS] = hashed / np.maximum(norm, 1)
    size = np.maximum(off[1:] - off[:-1], 1).astype(np.float64)
    count = np.maximum(np.bincount(rows, minlength=n), 1)
    stops = texts.table_of(b".,;:!?")[raw]
    sums = np.concatenate([[0], np.cumsum(stops)])
    digits = np.concatenate([[0], np.cumsum(texts.table_of(b"0123456789")[raw])])
    linked = np.array([k for _, _, k in flat], np.float64)
    place = np.concatenate([np.linspace(0, 1, len(p)) for p in pages if p])
    out[:, PATH + WORDS :] = np.stack(
        [
            np.log1p(size) / 4 - 1, np.log1p(count) / 2 - 1, np.minimum(linked / size, 1), 8 * (sums[off[1:]] - sums[off[:-1]]) / size,
            (digits[off[1:]] - digits[off[:-1]]) / size, size / count / 10, place, np.array([t[-1:] in ".!?" for _, t, _ in flat], float),
        ],
        axis=1,
    )
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def fresh(rng: np.random.Generator) -> Labeller:
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.1, (WIDTH, 4 * HIDDEN)).astype(np.float32)
            w[f"h{d}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            w[f"c{d}"] = np.zeros(4 * HIDDEN, np.float32)
            w[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
        w["o"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        w["z"] = np.zeros(1, np.float32)
        return Labeller(w)

    def _pass(self, x, mask, d, keep):
        """States of one direction for (time, pages, 4 * HIDDEN) inputs; masked steps hold the state."""
        steps, pages = mask.shape
        h = c = np.zeros((pages, HIDDEN), np.float32)
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        trace = []
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        weight = self.w[f"h{d}"]
        for t in order:
            g = x[t] + h @ weight
            i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            u = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            nc = np.where(m, f * c + i * u, c)
            tc = np.tanh(nc)
            nh = np.where(m, o * tc, h)
            if keep:
                trace.append((t, i, f, o, u, c, tc, h, m))
            h, c = nh, nc
            out[t] = h
        return out, trace

    def scores(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of (time, pages, WIDTH) inputs."""
        shape = mask.shape
        flat = x.reshape(-1, WIDTH)
        traces = {}
        logit = np.full(shape, self.w["z"][0], np.float32)
        for k, d in enumerate("fb"):
            gates = (flat @ self.w[f"x{d}"] + self.w[f"c{d}"]).reshape(*shape, 4 * HIDDEN)
            h, trace = self._pass(gates, mask, d, keep)
            logit += h @ self.w["o"][k * HIDDEN : (k + 1) * HIDDEN]
            traces[d] = (h, trace)
        return logit, traces

    def gradients(self, x, mask, truth):
        logit, traces = self.scores(x, mask, keep=True)
        weight = mask / max(1, mask.sum())
        delta = ((_sigmoid(logit) - truth) * weight).astype(np.float32)
        grad = {"z": np.array([delta.sum()], np.float32)}
        parts = []
        for k, d in enumerate("fb"):
            h, trace = traces[d]
            out = self.w["o"][k * HIDDEN : (k + 1) * HIDDEN]
            parts.append((h * delta[..., None]).sum((0, 1)))
            gx = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            gw = np.zeros_like(self.w[f"h{d}"])
            dh = np.zeros((mask.shape[1], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for t, i, f, o, u, c, tc, before, m in reversed(trace):
                dh = dh + delta[t][:, None] * out
                ds = np.where(m, dh * o * (1 - tc**2) + dc, 0)
                g = np.concatenate(
                    [ds * u * i * (1 - i), ds * c * f * (1 - f), np.where(m, dh * tc, 0) * o * (1 - o), ds * i * (1 - u**2)], 1
                )
                gx[t] = g
                gw += before.T @ g
                dh = np.where(m, 0, dh) + g @ self.w[f"h{d}"].T
                dc = np.where(m, ds * f, dc)
            grad[f"h{d}"], grad[f"c{d}"] = gw, gx.sum((0, 1))
            grad[f"x{d}"] = x.reshape(-1, WIDTH).T @ gx.reshape(-1, 4 * HIDDEN)
        grad["o"] = np.concatenate(parts)
        return grad

    def label(self, pages: list[list], most: int = 20_000) -> list[np.ndarray]:
        """Whether each block is main text, page by page; pages of like length go together."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and len(pages[order[to]]) * (to + 1 - at) <= most:
                to += 1
            some = [pages[k] for k in order[at:to]]
            x, mask = padded(some)
            logit, _ = self.scores(x, mask)
            for k, page in enumerate(some):
                out[order[at + k]] = logit[: len(page), k] > 0
            at = to
        return out


def padded(pages: list[list]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(p) for p in pages]
    x = np.zeros((max(sizes), len(pages), WIDTH), np.float32)
    mask = np.zeros(x.shape[:2], bool)
    rows, at = features(pages), 0
    for k, n in enumerate(sizes):
        x[:n, k], mask[:n, k] = rows[at : at + n], True
        at += n
    return x, mask


def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """Fit on ``pages`` generated pages with Adam; the last layer is scored on blocks alike."""
    made = [sample_page(random.Random(seed * 100_003 + k)) for k in range(pages)]
    rng = np.random.default_rng(seed)
    model = Labeller.fresh(rng)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step, size = 0, 30
    batches = []
    for at in range(0, pages, size):
        some = sorted(made[at : at + size], key=lambda p: len(p[0]))
        x, mask = padded([p for p, _ in some])
        truth = np.zeros(mask.shape, np.float32)
        for k, (_, y) in enumerate(some):
            truth[: len(y), k] = y
        batches.append((x, mask, truth))
    for epoch in range(epochs):
        rate = 0.01 * 0.8**epoch
        for k in rng.permutation(len(batches)):
            step += 1
            for name, g in model.gradients(*batches[k]).items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                model.w[name] -= (
                    rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)
                ).astype(np.float32)
    return model


# --- generated pages ------------------------------------------------------------------------

_SYLLABLES = "an be chi do er fu ga hen il jo ka le mi no or pa que ra sto ti un ver wa xe ys zo é ü".split()
#: Names that sites give to the parts of their pages.
_NAMES = {
    "main": "content main article post entry story body text entry-content post-content article-body page-content",
    "nav": "nav menu navigation navbar topnav breadcrumb breadcrumbs main-menu links pagination tabs toc",
    "ad": "ad ads advert advertisement banner sponsor sponsored promo ad-slot adbox google-ads",
    "side": "sidebar widget aside related recommended trending popular more-stories tags share social",
    "foot": "footer copyright site-footer colophon legal bottom",
    "head": "header masthead site-header logo branding topbar hero",
    "note": "notice cookie cookie-banner alert gdpr consent popup modal paywall disclaimer warning",
    "form": "form search newsletter subscribe login signup search-form contact poll",
    "talk": "comments comment comment-list commentlist replies discussion reader-comments disqus thread",
}


def sample_page(rng: random.Random) -> tuple[list, np.ndarray]:
    """Blocks of a generated page and their labels (1: main text)."""

    def word():
        return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))

    def words(lo, hi):
        return " ".join(word() for _ in range(rng.randint(lo, hi)))

    def prose(mark, lo=1, hi=5):
        lines = [f"{words(2, 20).capitalize()}{rng.choice(['.', '.', '.', '!', '?'])}" for _ in range(rng.randint(lo, hi))]
        return mark + " ".join(lines)

    def named(kind, tags):
        tag = rng.choice(tags)
        if rng.random() < 0.85 or tag in ("div", "section", "ul"):
            name = rng.choice(_NAMES[kind].split()) + rng.choice(["", "", "", f"-{rng.randint(1, 40)}"])
            return f'<{tag} {rng.choice(["class", "class", "id"])}="{name}">', f"</{tag}>"
        return f"<{tag}>", f"</{tag}>"

    M, O = "\x01", "\x02"

    def links(mark, lo=2, hi=8):
        item = [f'<li><a href="/{word()}">{mark}{words(1, 3)}</a></li>' for _ in range(rng.randint(lo, hi))]
        if rng.random() < 0.2:
            return " | ".join(f'<a href="#">{mark}{words(1, 2)}</a>' for _ in item)
        return f"<ul>{''.join(item)}</ul>"

    def paragraph(mark):
        body = prose(mark)
        if rng.random() < 0.2:
            body += f' <a href="/x">{words(1, 4)}</a> {words(2, 9)}.'
        if rng.random() < 0.15:
            body = mark + f"<b>{body[1:]}<br>" if rng.random() < 0.5 else mark + f"<em>{body[1:]}</em>"
        return f"<p>{body}" + ("" if rng.random() < 0.15 else "</p>")

    def main_piece():
        k = rng.random()
        if k < 0.66:
            return paragraph(M)
        if k < 0.76:
            h = rng.choice("234")
            return f"<h{h}>{M}{words(1, 8)}</h{h}>"
        if k < 0.84:
            return "<ul>" + "".join(f"<li>{prose(M, 1, 2)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if k < 0.88:
            return f"<blockquote><p>{prose(M)}</p></blockquote>"
        if k < 0.91:
            return f"<pre>{M}{words(3, 12)}\n{words(2, 9)}</pre>"
        if k < 0.94:
            rows = "".join(f"<tr><td>{M}{words(1, 3)}</td><td>{M}{rng.randint(1, 999)}</td></tr>" for _ in range(rng.randint(1, 4)))
            return f"<table>{rows}</table>"
        if k < 0.96:
            return f"<p>{M}{words(1, 3)}</p>"
        if k < 0.98:
            return f'<figure><img src="x"><figcaption>{M}{words(3, 12)}</figcaption></figure>'
        return f"<div>{prose(M)}</div>"

    def other(kind):
        if kind == "nav":
            a, b = named("nav", ["nav", "div", "ul", "nav"])
            return a + links(O) + b
        if kind == "ad":
            a, b = named("ad", ["div", "aside", "section", "div"])
            return a + rng.choice([prose(O, 1, 2), f"<p>{prose(O, 1, 3)}</p>", links(O, 1, 2)]) + b
        if kind == "side":
            a, b = named("side", ["aside", "div", "section"])
            return a + rng.choice(["", f"<h3>{O}{words(1, 3)}</h3>"]) + rng.choice([links(O), paragraph(O), links(O, 3, 9)]) + b
        if kind == "foot":
            a, b = named("foot", ["footer", "div", "footer"])
            return a + rng.choice([f"{O}&copy; {word()}.example &middot; {words(2, 18)}", links(O) + f"<p>{O}&copy; {words(2, 12)}.</p>", prose(O, 1, 2)]) + b
        if kind == "head":
            a, b = named("head", ["header", "div"])
            return a + f"<h1>{O}{words(1, 3)}</h1>" + rng.choice(["", f"<p>{O}{words(3, 8)}</p>"]) + b
        if kind == "note":
            a, b = named("note", ["div", "section", "aside"])
            return a + f"<p>{prose(O, 1, 3)}</p>" + rng.choice(["", f"<button>{O}{words(1, 2)}</button>"]) + b
        if kind == "form":
            a, b = named("form", ["form", "form", "div"])
            tail = "" if a.startswith("<form") else "</form>"
            return a + ("" if a.startswith("<form") else "<form>") + f"<p>{O}{words(2, 9)}</p><label>{O}{words(1, 3)}</label><input><select><option>{O}{word()}<option>{O}{word()}</select><button>{O}{words(1, 2)}</button>" + tail + b
        a, b = named("talk", ["section", "div", "ol"])
        item = rng.choice(['<li class="comment">', '<div class="comment">', '<div class="reply">', '<article class="comment">'])
        end = "</" + item[1:].split()[0] + ">"
        return a + f"<h3>{O}{words(1, 3)}</h3>" + "".join(
            f"{item}<span>{O}{word()}</span> <p>{prose(O, 1, 3)}</p>{end}" for _ in range(rng.randint(1, 6))
        ) + b

    open_, close = named("main", ["article", "article", "main", "div", "section"])
    if rng.random() < 0.25:
        outer = named("main", ["main", "div"])
        open_, close = outer[0] + open_, close + outer[1]
    body = [f"<h1>{M}{words(2, 10)}</h1>"] if rng.random() < 0.85 else []
    if rng.random() < 0.3 and body:
        body.append(f"<p><b>{M}{words(2, 12)}.<br>")
    for _ in range(rng.choice([1, 2, 3, 5, 8, 14, 25])):
        body.append(main_piece())
        if rng.random() < 0.06:
            body.append(other(rng.choice(["ad", "side", "form", "note", "ad"])))
    if rng.random() < 0.15:
        body.append(other("talk"))
    before = [k for k in ("note", "head", "nav", "form", "ad", "side") if rng.random() < {"nav": 0.85, "head": 0.5, "ad": 0.4}.get(k, 0.2)]
    if rng.random() < 0.3:
        rng.shuffle(before)
    after = [k for k in ("ad", "talk", "side", "nav", "form", "foot", "note") if rng.random() < {"foot": 0.85, "talk": 0.35, "side": 0.4}.get(k, 0.2)]
    page = (
        f"<html><head><title>{O}{words(2, 8)}</title></head><body>"
        + "".join(other(k) for k in before) + open_ + "".join(body) + close + "".join(other(k) for k in after) + "</body></html>"
    )
    found, labels = [], []
    for path, text, linked in blocks(page):
        labels.append(M in text)
        text = text.replace(M, "").replace(O, "").strip()
        if text:
            found.append((path, text, linked))
        else:
            labels.pop()
    return found, np.array(labels, np.float32)
