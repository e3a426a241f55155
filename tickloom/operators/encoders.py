"""Forward passes of window encoders on supplied weights, for ``models.scored``: a network is a list of layers, each with the prefix of its weights.

Arrays are [windows, ticks, channels]. Weights are a dictionary of arrays by
``prefix.name``; nothing is trained here. Each layer is a few numpy lines, and
Spark decides which windows meet in a batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Weights = dict[str, np.ndarray]
Layer = tuple


def positional(length: int, width: int) -> np.ndarray:
    """Sines at even and cosines at odd places, with wavelengths in a geometric series up to 10,000."""
    angle = np.arange(length)[:, None] * 10_000.0 ** (-np.arange(0, width, 2) / width)
    return np.stack([np.sin(angle), np.cos(angle)], -1).reshape(length, -1)[:, :width]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def gelu(x: np.ndarray) -> np.ndarray:
    """x times the normal distribution function (within 2e-7 of it)."""
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return x * np.where(x >= 0, 1 - tail / 2, tail / 2)


def linear(x: np.ndarray, w: Weights, at: str) -> np.ndarray:
    return x @ w[f"{at}.weight"].T + w[f"{at}.bias"]


def conv(x: np.ndarray, w: Weights, at: str, dilation: int = 1, stride: int = 1) -> np.ndarray:
    """Centred convolution over ticks; weight [out, in, width] of odd width, a bias where there is one."""
    kernel = w[f"{at}.weight"]
    half = (kernel.shape[2] - 1) // 2 * dilation
    padded = np.pad(x, ((0, 0), (half, half), (0, 0)))
    out = sum(padded[:, k * dilation : k * dilation + x.shape[1] : stride] @ kernel[:, :, k].T for k in range(kernel.shape[2]))
    return out + w.get(f"{at}.bias", 0.0)


def scaled(x: np.ndarray, w: Weights, at: str, axes: tuple[int, ...], eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(axes, keepdims=True)) / np.sqrt(x.var(axes, keepdims=True) + eps)


def group_norm(x: np.ndarray, w: Weights, at: str, groups: int = 8) -> np.ndarray:
    n, ticks, width = x.shape
    out = scaled(x.reshape(n, ticks, groups, -1), w, at, (1, 3)).reshape(x.shape)
    return out * w[f"{at}.weight"] + w[f"{at}.bias"]


def layer_norm(x: np.ndarray, w: Weights, at: str) -> np.ndarray:
    return scaled(x, w, at, (-1,)) * w[f"{at}.weight"] + w[f"{at}.bias"]


def batch_norm(x: np.ndarray, w: Weights, at: str) -> np.ndarray:
    return (x - w[f"{at}.running_mean"]) / np.sqrt(w[f"{at}.running_var"] + 1e-5) * w[f"{at}.weight"] + w[f"{at}.bias"]


def lstm(x: np.ndarray, w: Weights, at: str) -> np.ndarray:
    """All hidden states; weights [4 x hidden, ...] in the order input, forget, cell, output, one bias or two."""
    bias = w[f"{at}.bias_ih"] + w.get(f"{at}.bias_hh", 0.0)
    given, back = x @ w[f"{at}.weight_ih"].T + bias, w[f"{at}.weight_hh"].T
    h = c = np.zeros((len(x), back.shape[0]))
    states = []
    for tick in range(x.shape[1]):
        i, f, g, o = np.split(given[:, tick] + h @ back, 4, 1)
        c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
        h = sigmoid(o) * np.tanh(c)
        states.append(h)
    return np.stack(states, 1) if states else np.zeros((len(x), 0, back.shape[0]))


def attention(x: np.ndarray, w: Weights, at: str, heads: int = 4, mask: np.ndarray | None = None) -> np.ndarray:
    """Self-attention; ``mask`` [windows, ticks] is true where there is something to look at."""
    n, ticks, width = x.shape
    q, k, v = np.split(x @ w[f"{at}.in_proj_weight"].T + w[f"{at}.in_proj_bias"], 3, -1)
    part = lambda z: z.reshape(n, ticks, heads, -1).transpose(0, 2, 1, 3)
    score = part(q) @ part(k).transpose(0, 1, 3, 2) / np.sqrt(width // heads)
    if mask is not None:
        score = np.where(mask[:, None, None, :], score, -np.inf)
    score = np.exp(score - score.max(-1, keepdims=True))
    mixed = (score / score.sum(-1, keepdims=True)) @ part(v)
    return linear(mixed.transpose(0, 2, 1, 3).reshape(n, ticks, width), w, f"{at}.out_proj")


def block(x: np.ndarray, w: Weights, at: str, heads: int = 4, mask: np.ndarray | None = None) -> np.ndarray:
    """Attention and a feed-forward part, each added to what came in, which is normalised first."""
    x = x + attention(layer_norm(x, w, f"{at}.norm1"), w, f"{at}.self_attn", heads, mask)
    return x + linear(gelu(linear(layer_norm(x, w, f"{at}.norm2"), w, f"{at}.linear1")), w, f"{at}.linear2")


def residual(x: np.ndarray, w: Weights, at: str, dilation: int = 1) -> np.ndarray:
    """Two dilated convolutions with group norms, added to what came in."""
    inner = gelu(group_norm(conv(x, w, f"{at}.net.0", dilation), w, f"{at}.net.1"))
    return gelu(x + group_norm(conv(inner, w, f"{at}.net.4", dilation), w, f"{at}.net.5"))


def branches(x: np.ndarray, w: Weights, at: str, stride: int = 1) -> np.ndarray:
    """Three widths of convolution over a bottleneck and one over a running maximum, side by side, added to what came in."""
    low = conv(x, w, f"{at}.bottleneck")
    padded = np.pad(x, ((0, 0), (1, 1), (0, 0)), constant_values=-np.inf)
    most = np.max([padded[:, k : k + x.shape[1]] for k in range(3)], 0)[:, ::stride]
    wide = np.concatenate([*(conv(low, w, f"{at}.branches.{k}", stride=stride) for k in range(3)), conv(most, w, f"{at}.pool.1")], -1)
    skip = batch_norm(conv(x, w, f"{at}.skip.0", stride=stride), w, f"{at}.skip.1") if f"{at}.skip.0.weight" in w else x
    return gelu(batch_norm(wide, w, f"{at}.norm") + skip)


def patches(x: np.ndarray, size: int = 8) -> np.ndarray:
    return x.reshape(len(x), x.shape[1] // size, -1)


def thirds(x: np.ndarray) -> np.ndarray:
    """Mean and maximum over ticks, and the means of three parts of them, channel by channel."""
    n = x.shape[1]
    parts = [x[:, n * k // 3 : -(-n * (k + 1) // 3)].mean(1) for k in range(3)]
    return np.concatenate([x.mean(1), x.max(1), np.stack(parts, -1).reshape(len(x), -1)], 1)


#: Layers by name. A layer of a network is (name, prefix of its weights, further arguments).
LAYERS: dict[str, Callable[..., np.ndarray]] = {
    "linear": linear, "conv": conv, "group_norm": group_norm, "layer_norm": layer_norm, "batch_norm": batch_norm, "lstm": lstm, "block": block, "residual": residual, "branches": branches,
    "gelu": lambda x, w, at: gelu(x), "relu": lambda x, w, at: np.maximum(x, 0), "last": lambda x, w, at: x[:, -1], "flat": lambda x, w, at: x[..., 0],
    "halved": lambda x, w, at: x[:, : x.shape[1] // 2 * 2].reshape(len(x), -1, 2, x.shape[2]).mean(2), "mean_max": lambda x, w, at: np.concatenate([x.mean(1), x.max(1)], 1), "mean_last": lambda x, w, at: np.concatenate([x.mean(1), x[:, -1]], 1),
    "patches": lambda x, w, at: patches(x), "placed": lambda x, w, at: x + 0.1 * positional(x.shape[1], x.shape[2]), "thirds": lambda x, w, at: thirds(x),
}


def forward(layers: list[Layer], weights: Weights, x: np.ndarray) -> np.ndarray:
    for name, at, *rest in layers:
        x = LAYERS[name](x, weights, at, *rest)
    return x


#: Encoders of windows; each ends in one vector a window.
ENCODERS: dict[str, list[Layer]] = {
    "lstm": [("lstm", "first"), ("lstm", "second"), ("last", "")],
    "tcn": [("conv", "net.0"), ("group_norm", "net.1"), ("gelu", ""), ("residual", "net.3", 1), ("residual", "net.4", 2), ("residual", "net.5", 4), ("halved", ""), ("residual", "net.7", 4), ("mean_max", ""), ("linear", "out.0"), ("gelu", "")],
    "transformer": [("patches", ""), ("linear", "input"), ("placed", ""), *[("block", f"net.layers.{k}") for k in range(3)], ("mean_max", ""), ("layer_norm", "out.0"), ("linear", "out.1"), ("gelu", "")],
    "multiscale": [("conv", "net.0"), ("batch_norm", "net.1"), ("gelu", ""), ("branches", "net.3", 1), ("branches", "net.4", 2), ("branches", "net.5", 2), ("thirds", ""), ("linear", "project.0"), ("layer_norm", "project.1"), ("gelu", "")],
    "reference_lstm": [("lstm", "lstm1"), ("lstm", "lstm2"), ("last", ""), ("linear", "classifier.0"), ("relu", ""), ("linear", "classifier.3"), ("flat", "")],
}
HEAD: list[Layer] = [("linear", "event_head.0"), ("relu", ""), ("linear", "event_head.3"), ("flat", "")]


def event_logits(kind: str, weights: Weights) -> Callable[[np.ndarray], np.ndarray]:
    """A function of windows for ``models.scored``: the logit of each."""
    return lambda x: forward(HEAD, weights, forward(ENCODERS[kind], {k.removeprefix("encoder."): v for k, v in weights.items()}, x))


def hierarchical(encoded: np.ndarray, mask: np.ndarray, w: Weights) -> np.ndarray:
    """One logit for each player from [players, windows, width] and which of them are there."""
    x = linear(encoded, w, "project")
    x = x + 0.1 * positional(x.shape[1], x.shape[2])
    for k in range(2):
        x = block(x, w, f"sequence.layers.{k}", mask=mask)
    here = mask[..., None]
    both = np.concatenate([(x * here).sum(1) / here.sum(1), np.where(here, x, -1e4).max(1)], 1)
    return forward([("layer_norm", "match_head.0"), ("linear", "match_head.1"), ("gelu", ""), ("linear", "match_head.4"), ("flat", "")], w, both)


def gated_pool(h: np.ndarray, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """[players, windows, width] pooled by gated attention, mean, maximum and deviation; and the attention."""
    a = linear(np.tanh(linear(h, w, "attention_v")) * sigmoid(linear(h, w, "attention_u")), w, "attention_w")
    a = np.exp(a - a.max(1, keepdims=True))
    a = a / a.sum(1, keepdims=True)
    return np.concatenate([(a * h).sum(1), h.mean(1), h.max(1), h.std(1)], 1), a[..., 0]
