"""Words are remembered side by side, a batch at a time, with the forms that `canonical` gives each of them."""

from ledgerspan.llm.decontaminate import NAME, Templates, _hash, canonical

TEXTS = ["Anna paid $5.50 for 3kg; Bob_ didn't. The O'Neil's cost", None, "", "ten Ten miles Über straße ǅ X a_ _ -- 12km/h (Paris) ½ ß. Anna",
         "McDonald iPhone ABC abc. Abc", "漢字 漢字。 ÉCOLE École école"]


def test_a_batch_is_remembered_at_once_with_canonical_forms(monkeypatch):
    calls, plain = [], Templates._remember
    monkeypatch.setattr(Templates, "_remember", lambda self, *a: calls.append(len(a[1])) or plain(self, *a))
    templates = Templates()
    tokens = templates.tokens(TEXTS)
    words = [w for t in TEXTS for w in (t or "").split(" ") if w]
    want = [(form, value) for w in words for form, value in canonical(w)]
    assert tokens.named.tolist() == [_hash(form) for form, _ in want]
    assert all(p == n or p == _hash(value) and form == NAME
               for p, n, (form, value) in zip(tokens.plain.tolist(), tokens.named.tolist(), want))
    assert calls == [len(set(words))]
    again = templates.tokens(TEXTS)
    assert again.plain.tolist() == tokens.plain.tolist() and len(calls) == 1
    small = Templates(room=2).tokens(TEXTS)
    assert small.plain.tolist() == tokens.plain.tolist() and small.named.tolist() == tokens.named.tolist()
