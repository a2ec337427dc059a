"""Line charts and heat maps of small results as SVG text, without a plotting library."""

from __future__ import annotations

from html import escape

WIDTH, HEIGHT, EDGE = 640, 400, 60
COLOURS = ("#1b6ca8", "#c8553d", "#588157", "#7a4ea3", "#8a6d3b")


def _page(parts: list[str]) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif" font-size="12">'
    return "\n".join([head, f'<rect width="{WIDTH}" height="{HEIGHT}" fill="white"/>', *parts, "</svg>"]) + "\n"


def _text(x: float, y: float, s: str, anchor: str = "middle") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}">{escape(s)}</text>'


def lines(series: dict[str, list[tuple[float, float]]], x_name: str, y_name: str) -> str:
    """A line with points for each named series of (x, y)."""
    points = [p for own in series.values() for p in own]
    xs, ys = [p[0] for p in points] or [0], [p[1] for p in points] or [0]
    left, right, low, high = min(xs), max(xs), min(0, *ys), max(ys)
    at = lambda x, y: (EDGE + (x - left) / ((right - left) or 1) * (WIDTH - 2 * EDGE), HEIGHT - EDGE - (y - low) / ((high - low) or 1) * (HEIGHT - 2 * EDGE))
    parts = [f'<path d="M{EDGE} {EDGE}V{HEIGHT - EDGE}H{WIDTH - EDGE}" fill="none" stroke="#444"/>', _text(WIDTH / 2, HEIGHT - 15, x_name), _text(EDGE, EDGE - 15, y_name)]
    for x in sorted(set(xs)):
        parts.append(_text(at(x, low)[0], HEIGHT - EDGE + 18, f"{x:g}"))
    for y in sorted({low, (low + high) / 2, high}):
        parts.append(_text(EDGE - 6, at(left, y)[1] + 4, f"{y:.3g}", "end"))
    for n, (name, own) in enumerate(series.items()):
        colour, places = COLOURS[n % len(COLOURS)], [at(*p) for p in sorted(own)]
        parts.append(f'<polyline fill="none" stroke="{colour}" stroke-width="2" points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in places)}"/>')
        parts += [f'<circle cx="{x:.1f}" cy="{y:.1f}" r="3" fill="{colour}"/>' for x, y in places]
        parts += [f'<rect x="{WIDTH - EDGE - 130}" y="{EDGE + 18 * n - 9}" width="10" height="10" fill="{colour}"/>', _text(WIDTH - EDGE - 114, EDGE + 18 * n, name, "start")]
    return _page(parts)


def heat_map(cells: dict[tuple[float, float], float], x_name: str, y_name: str, title: str) -> str:
    """A coloured cell with its value for each (x, y)."""
    xs, ys = sorted({x for x, _ in cells}), sorted({y for _, y in cells})
    low, high = min(cells.values(), default=0.0), max(cells.values(), default=0.0)
    wide, tall = (WIDTH - 2 * EDGE) / max(1, len(xs)), (HEIGHT - 2 * EDGE) / max(1, len(ys))
    parts = [_text(WIDTH / 2, EDGE - 20, title), _text(WIDTH / 2, HEIGHT - 15, x_name), _text(20, HEIGHT / 2, y_name)]
    for (x, y), v in cells.items():
        a, b = EDGE + xs.index(x) * wide, HEIGHT - EDGE - (ys.index(y) + 1) * tall
        share = (v - low) / ((high - low) or 1)
        parts.append(f'<rect x="{a:.1f}" y="{b:.1f}" width="{wide:.1f}" height="{tall:.1f}" fill="#1b6ca8" fill-opacity="{0.15 + 0.6 * share:.2f}" stroke="white"/>')
        parts.append(_text(a + wide / 2, b + tall / 2, f"{v:.4f}"))
    parts += [_text(EDGE + (i + 0.5) * wide, HEIGHT - EDGE + 18, f"{x:g}") for i, x in enumerate(xs)]
    parts += [_text(EDGE - 10, HEIGHT - EDGE - (i + 0.5) * tall, f"{y:g}", "end") for i, y in enumerate(ys)]
    return _page(parts)


def save(path: str, svg: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(svg)
