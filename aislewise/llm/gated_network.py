"""A bidirectional gated recurrent network with attention pooling, in numpy, forwards and backwards.

A window is a row of word numbers; each word's input vector is looked up, both directions read the window, an
attention weight for each place pools the states, and the pooled state gives one logit.  Places beyond the end
of a text are masked: they leave a state as it is and have no weight.
"""

from __future__ import annotations

import numpy as np

STATE = 12
ATTENTION = 12


def _squashed(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def new_parameters(inputs: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Weights by name; a direction's gates are update, reset and candidate, side by side."""

    def drawn(rows: int, columns: int) -> np.ndarray:
        return (rng.standard_normal((rows, columns)) / np.sqrt(rows)).astype(np.float32)

    parameters = {}
    for way in ("forward", "backward"):
        parameters[f"{way}_input"] = drawn(inputs, 3 * STATE)
        parameters[f"{way}_bias"] = np.zeros(3 * STATE, np.float32)
        parameters[f"{way}_state"] = drawn(STATE, 3 * STATE)
    parameters["attention"] = drawn(2 * STATE, ATTENTION)
    parameters["attention_bias"] = np.zeros(ATTENTION, np.float32)
    parameters["focus"] = drawn(ATTENTION, 1)[:, 0]
    parameters["output"] = drawn(2 * STATE, 1)[:, 0]
    parameters["output_bias"] = np.zeros(1, np.float32)
    return parameters


def projected(parameters: dict[str, np.ndarray], inputs: np.ndarray) -> dict[str, np.ndarray]:
    """What each word adds to the gates of either direction: computed once a word, not once a place."""
    return {
        way: inputs @ parameters[f"{way}_input"] + parameters[f"{way}_bias"] for way in ("forward", "backward")
    }


def _read(gates: np.ndarray, words: np.ndarray, mask: np.ndarray, weights: np.ndarray, places, kept: list | None):
    """States at all places, in the order of ``places``; ``kept`` gets what the way back needs."""
    states = np.zeros((words.shape[1], words.shape[0], STATE), np.float32)
    state = np.zeros((words.shape[0], STATE), np.float32)
    for at in places:
        own, before = gates[words[:, at]], state @ weights
        opened = _squashed(own[:, : 2 * STATE] + before[:, : 2 * STATE])
        update, reset = opened[:, :STATE], opened[:, STATE:]
        candidate = np.tanh(own[:, 2 * STATE :] + reset * before[:, 2 * STATE :])
        update = update * mask[:, at, None]
        if kept is not None:
            kept.append((at, state, update, reset, candidate, before[:, 2 * STATE :]))
        state = state + update * (candidate - state)
        states[at] = state
    return states


def forward(parameters, gates, words: np.ndarray, mask: np.ndarray, keep: bool = False):
    """The logit of each window, and what ``backward`` needs if asked for."""
    length = words.shape[1]
    kept = {"forward": [], "backward": []} if keep else {"forward": None, "backward": None}
    ways = [
        _read(gates[way], words, mask, parameters[f"{way}_state"], places, kept[way])
        for way, places in (("forward", range(length)), ("backward", range(length - 1, -1, -1)))
    ]
    states = np.concatenate(ways, axis=2)
    looked = np.tanh(states @ parameters["attention"] + parameters["attention_bias"])
    strength = looked @ parameters["focus"] + np.where(mask.T > 0, 0, -1e9).astype(np.float32)
    strength = np.exp(strength - strength.max(axis=0))
    weight = strength / strength.sum(axis=0)
    pooled = np.einsum("tb,tbs->bs", weight, states)
    logits = pooled @ parameters["output"] + parameters["output_bias"]
    return (logits, (kept, states, looked, weight, pooled)) if keep else (logits, None)


def backward(parameters, words: np.ndarray, mask: np.ndarray, found, slope: np.ndarray):
    """Gradients of the weights and of the gates at each place, for the slope of the loss in each logit."""
    kept, states, looked, weight, pooled = found
    grown = {"output": pooled.T @ slope, "output_bias": slope.sum(keepdims=True)}
    d_pooled = slope[:, None] * parameters["output"]
    d_weight = np.einsum("bs,tbs->tb", d_pooled, states)
    d_strength = weight * (d_weight - (weight * d_weight).sum(axis=0))
    grown["focus"] = np.einsum("tb,tba->a", d_strength, looked)
    d_looked = d_strength[:, :, None] * parameters["focus"] * (1 - looked**2)
    grown["attention"] = np.einsum("tbs,tba->sa", states, d_looked)
    grown["attention_bias"] = d_looked.sum(axis=(0, 1))
    d_states = weight[:, :, None] * d_pooled + d_looked @ parameters["attention"].T
    d_gates = {}
    for way, own in (("forward", slice(0, STATE)), ("backward", slice(STATE, 2 * STATE))):
        weights = parameters[f"{way}_state"]
        d_weights = np.zeros_like(weights)
        places = np.zeros((words.shape[1], words.shape[0], 3 * STATE), np.float32)
        d_state = np.zeros((words.shape[0], STATE), np.float32)
        for at, state, update, reset, candidate, before in reversed(kept[way]):
            d_state = d_state + d_states[at][:, own]
            d_update = d_state * (candidate - state) * update * (mask[:, at, None] - update)
            d_candidate = d_state * update * (1 - candidate**2)
            d_reset = d_candidate * before * reset * (1 - reset)
            d_before = np.concatenate([d_update, d_reset, d_candidate * reset], axis=1)
            places[at] = np.concatenate([d_update, d_reset, d_candidate], axis=1)
            d_weights += state.T @ d_before
            d_state = d_state * (1 - update) + d_before @ weights.T
        grown[f"{way}_state"] = d_weights
        grown[f"{way}_bias"] = places.sum(axis=(0, 1))
        d_gates[way] = places
    return grown, d_gates


class Adam:
    """Adaptive steps for arrays by name."""

    def __init__(self, parameters: dict[str, np.ndarray], rate: float) -> None:
        self._parameters, self._rate, self._steps = parameters, rate, 0
        self._first = {k: np.zeros_like(v) for k, v in parameters.items()}
        self._second = {k: np.zeros_like(v) for k, v in parameters.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self._steps += 1
        scale = self._rate * np.sqrt(1 - 0.999**self._steps) / (1 - 0.9**self._steps)
        for name, gradient in gradients.items():
            first, second = self._first[name], self._second[name]
            first += 0.1 * (gradient - first)
            second += 0.001 * (gradient**2 - second)
            self._parameters[name] -= (scale * first / (np.sqrt(second) + 1e-7)).astype(np.float32)
