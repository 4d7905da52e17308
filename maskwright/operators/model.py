"""A numpy forward pass of the sparse transformer tagger, and its checkpoint reader.

Attention is banded: each token sees ``window`` tokens on either side, so time and memory grow with T times
the band, never with T squared. Weights are memory-mapped and widened from bfloat16 one tensor at a time.
"""

from __future__ import annotations

import json
import math
import os
from dataclasses import dataclass

import numpy as np

MAX_TABLE = 16384


@dataclass(frozen=True)
class ModelConfig:
    vocab_size: int
    hidden_size: int
    intermediate_size: int
    num_hidden_layers: int
    num_attention_heads: int
    num_key_value_heads: int
    head_dim: int
    num_local_experts: int
    num_experts_per_tok: int
    sliding_window: int
    rms_norm_eps: float
    rope_theta: float
    rope_factor: float
    original_max_position_embeddings: int
    beta_fast: float
    beta_slow: float
    swiglu_limit: float = 7.0
    num_labels: int = 33

    @classmethod
    def from_file(cls, path: str) -> ModelConfig:
        with open(path, encoding="utf-8") as file:
            raw = json.load(file)
        rope = raw.get("rope_parameters", {})
        flat = raw | rope | {"rope_factor": rope.get("factor")}
        return cls(**{k: flat[k] for k in cls.__dataclass_fields__ if flat.get(k) is not None})

    @property
    def max_tokens(self) -> int:
        return min(int(self.original_max_position_embeddings * self.rope_factor), MAX_TABLE)


class SafeTensors:
    """Named tensors of one file, read on demand as float32."""

    _WIDTH = {"F32": 4, "F16": 2, "BF16": 2}

    def __init__(self, path: str):
        with open(path, "rb") as file:
            size = int.from_bytes(file.read(8), "little")
            head = json.loads(file.read(size))
        self.entries = {k: v for k, v in head.items() if k != "__metadata__"}
        self.base, self.path = 8 + size, path
        self.bytes = np.memmap(path, np.uint8, "r")

    def __contains__(self, name: str) -> bool:
        return name in self.entries

    def __getitem__(self, name: str) -> np.ndarray:
        entry = self.entries[name]
        if entry["dtype"] not in self._WIDTH:
            raise ValueError(f"{name}: unsupported type {entry['dtype']}")
        a, b = entry["data_offsets"]
        raw = self.bytes[self.base + a : self.base + b]
        if entry["dtype"] == "BF16":
            out = (raw.view("<u2").astype(np.uint32) << 16).view(np.float32)
        else:
            out = raw.view("<f4" if entry["dtype"] == "F32" else "<f2").astype(np.float32)
        return out.reshape(entry["shape"])


def write_safetensors(path: str, tensors: dict[str, np.ndarray]) -> None:
    """Float32 tensors in the same format, for tests and conversions."""
    head, at = {}, 0
    for name, value in tensors.items():
        size = value.size * 4
        head[name] = {"dtype": "F32", "shape": list(value.shape), "data_offsets": [at, at + size]}
        at += size
    raw = json.dumps(head).encode()
    with open(path, "wb") as file:
        file.write(len(raw).to_bytes(8, "little") + raw + b"".join(np.ascontiguousarray(v, "<f4").tobytes() for v in tensors.values()))


def rms_norm(x: np.ndarray, scale: np.ndarray, eps: float) -> np.ndarray:
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + eps) * scale


def rope_table(c: ModelConfig, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and sines by position, frequencies blended by parts between interpolation and extrapolation."""
    half = c.head_dim // 2
    rate = c.rope_theta ** (np.arange(half) * 2 / c.head_dim)
    if c.rope_factor > 1:
        bound = lambda turns: half * math.log(c.original_max_position_embeddings / (turns * 2 * math.pi)) / math.log(c.rope_theta)
        low, high = bound(c.beta_fast), bound(c.beta_slow)
        if not 0 < low < high < half - 1:
            raise ValueError("the ramp of rotary frequencies is out of range")
        ramp = np.clip((np.arange(half) - low) / (high - low), 0, 1)
        speed = ramp / (c.rope_factor * rate) + (1 - ramp) / rate
        gain = 0.1 * math.log(c.rope_factor) + 1
    else:
        speed, gain = 1 / rate, 1.0
    angle = np.arange(length)[:, None] * speed[None, :]
    return (np.cos(angle) * gain).astype(np.float32), (np.sin(angle) * gain).astype(np.float32)


def rotate(x: np.ndarray, cos: np.ndarray, sin: np.ndarray) -> np.ndarray:
    """Rotate neighbouring pairs (2i, 2i + 1) of [tokens, heads, dim]."""
    a, b = x[..., 0::2], x[..., 1::2]
    out = np.empty_like(x)
    out[..., 0::2] = a * cos[:, None] - b * sin[:, None]
    out[..., 1::2] = b * cos[:, None] + a * sin[:, None]
    return out


def banded_attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, sinks: np.ndarray, window: int, rows: int = 256) -> np.ndarray:
    """Softmax attention of [tokens, heads, dim] within ``window`` on either side. Each head has a virtual key of
    logit sink * ln 2 that takes its share and gives nothing."""
    t = len(q)
    out = np.empty_like(q)
    extra = (sinks * math.log(2)).astype(np.float32)[:, None]
    for a in range(0, t, rows):
        b = min(t, a + rows)
        lo, hi = max(0, a - window), min(t, b + window)
        score = np.einsum("qhd,khd->hqk", q[a:b], k[lo:hi])
        far = np.abs(np.arange(a, b)[:, None] - np.arange(lo, hi)[None, :]) > window
        score[:, far] = -np.inf
        top = np.maximum(score.max(2), extra)
        weight = np.exp(score - top[:, :, None])
        total = weight.sum(2) + np.exp(extra - top)
        out[a:b] = np.einsum("hqk,khd->qhd", weight / total[:, :, None], v[lo:hi])
    return out


def swiglu(x: np.ndarray, limit: float) -> np.ndarray:
    """First half gates, clamped above; second half is linear, clamped on both sides."""
    half = x.shape[-1] // 2
    gate, line = np.minimum(x[..., :half], limit), np.clip(x[..., half:], -limit, limit)
    return gate / (1 + np.exp(-1.702 * gate)) * (line + 1)


#: Role -> name in either naming scheme; {i} is the layer.
FUSED = {
    "embed": "embedding.weight", "norm": "norm.scale", "head": "unembedding.weight",
    "attn_norm": "block.{i}.attn.norm.scale", "qkv_w": "block.{i}.attn.qkv.weight", "qkv_b": "block.{i}.attn.qkv.bias", "sinks": "block.{i}.attn.sinks",
    "out_w": "block.{i}.attn.out.weight", "out_b": "block.{i}.attn.out.bias", "mlp_norm": "block.{i}.mlp.norm.scale",
    "gate_w": "block.{i}.mlp.gate.weight", "gate_b": "block.{i}.mlp.gate.bias", "up_w": "block.{i}.mlp.swiglu.weight", "up_b": "block.{i}.mlp.swiglu.bias",
    "down_w": "block.{i}.mlp.out.weight", "down_b": "block.{i}.mlp.out.bias",
}
SPLIT = {
    "embed": "model.embed_tokens.weight", "norm": "model.norm.weight", "head": "score.weight", "head_b": "score.bias",
    "attn_norm": "model.layers.{i}.input_layernorm.weight", "sinks": "model.layers.{i}.self_attn.sinks",
    "q_w": "model.layers.{i}.self_attn.q_proj.weight", "q_b": "model.layers.{i}.self_attn.q_proj.bias",
    "k_w": "model.layers.{i}.self_attn.k_proj.weight", "k_b": "model.layers.{i}.self_attn.k_proj.bias",
    "v_w": "model.layers.{i}.self_attn.v_proj.weight", "v_b": "model.layers.{i}.self_attn.v_proj.bias",
    "out_w": "model.layers.{i}.self_attn.o_proj.weight", "out_b": "model.layers.{i}.self_attn.o_proj.bias",
    "mlp_norm": "model.layers.{i}.post_attention_layernorm.weight",
    "gate_w": "model.layers.{i}.mlp.router.weight", "gate_b": "model.layers.{i}.mlp.router.bias",
    "up_w": "model.layers.{i}.mlp.experts.gate_up_proj", "up_b": "model.layers.{i}.mlp.experts.gate_up_proj_bias",
    "down_w": "model.layers.{i}.mlp.experts.down_proj", "down_b": "model.layers.{i}.mlp.experts.down_proj_bias",
}


class Transformer:
    """The tagger over any mapping of names to float32 tensors. Expert matrices are [expert, in, out]."""

    def __init__(self, config: ModelConfig, tensors):
        self.c, self.tensors = config, tensors
        self.names = FUSED if FUSED["embed"] in tensors else SPLIT
        self.rope = rope_table(config, config.max_tokens)

    @classmethod
    def load(cls, folder: str) -> Transformer:
        return cls(ModelConfig.from_file(os.path.join(folder, "config.json")), SafeTensors(os.path.join(folder, "model.safetensors")))

    def _get(self, role: str, i: int = 0) -> np.ndarray:
        return self.tensors[self.names[role].format(i=i)]

    def _qkv(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if self.names is FUSED:
            return self._get("qkv_w", i), self._get("qkv_b", i)
        return np.concatenate([self._get(f"{x}_w", i) for x in "qkv"]), np.concatenate([self._get(f"{x}_b", i) for x in "qkv"])

    def _attention(self, x: np.ndarray, i: int) -> np.ndarray:
        c, t = self.c, len(x)
        w, b = self._qkv(i)
        joint = rms_norm(x, self._get("attn_norm", i), c.rms_norm_eps) @ w.T + b
        nq, nk = c.num_attention_heads * c.head_dim, c.num_key_value_heads * c.head_dim
        q, k, v = (p.reshape(t, -1, c.head_dim) for p in np.split(joint, [nq, nq + nk], axis=1))
        cos, sin = self.rope[0][:t], self.rope[1][:t]
        scale = np.float32(c.head_dim**-0.25)
        q, k = rotate(q, cos, sin) * scale, rotate(k, cos, sin) * scale
        times = c.num_attention_heads // c.num_key_value_heads
        mixed = banded_attention(q, np.repeat(k, times, 1), np.repeat(v, times, 1), self._get("sinks", i), c.sliding_window)
        return x + mixed.reshape(t, -1) @ self._get("out_w", i).T + self._get("out_b", i)

    def _experts(self, x: np.ndarray, i: int) -> np.ndarray:
        c = self.c
        y = rms_norm(x, self._get("mlp_norm", i), c.rms_norm_eps)
        route = y @ self._get("gate_w", i).T + self._get("gate_b", i)
        k = c.num_experts_per_tok
        chosen = np.argsort(-route, axis=1, kind="stable")[:, :k]
        weight = np.take_along_axis(route, chosen, 1)
        weight = np.exp(weight - weight.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
        # Tokens sorted by expert, so each expert is one product over its bucket.
        flat = chosen.reshape(-1)
        order = np.argsort(flat, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=c.num_local_experts))])
        up_w, up_b, down_w, down_b = (self._get(r, i) for r in ("up_w", "up_b", "down_w", "down_b"))
        out = x.copy()
        for e in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[e] : cuts[e + 1]]
            token = at // k
            inner = swiglu(y[token] @ up_w[e] + up_b[e], c.swiglu_limit)
            np.add.at(out, token, (inner @ down_w[e] + down_b[e]) * weight.reshape(-1)[at, None])
        return out

    def forward(self, ids: np.ndarray) -> np.ndarray:
        """Logits [tokens, classes]; a text of more tokens than the rotary table is an error."""
        if len(ids) > self.c.max_tokens:
            raise ValueError(f"{len(ids)} tokens exceed the limit of {self.c.max_tokens}")
        x = self._get("embed")[ids]
        for i in range(self.c.num_hidden_layers):
            x = self._experts(self._attention(x, i), i)
        x = rms_norm(x, self._get("norm"), self.c.rms_norm_eps) @ self._get("head").T
        bias = self.names.get("head_b")
        return x + self.tensors[bias] if bias and bias in self.tensors else x
