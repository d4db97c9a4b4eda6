"""Fixed values that results depend on, stated plainly."""

#: Words that carry no topic.
STOP_WORDS = (
    "a an and are as at be because been but by can could did do does for from had has have he her here him his i if in into is it its just "
    "me more most my not of on or our out she so that the their them then there these they this to too up us was we were what when where "
    "which who why will with would you your"
).split()

#: Names of speakers by role, in order of precedence.
ROLE_ALIASES = {
    "human": ("user", "human", "person", "customer", "client", "altair"),
    "ai": ("assistant", "ai", "model", "ankaa", "chatgpt", "gpt"),
    "system": ("system",),
    "tool": ("tool", "browser", "search", "function", "shell", "mcp"),
}
#: The plain names of a role.
CANONICAL_NAMES = {"human": ("user", "human"), "ai": ("assistant", "ai"), "system": ("system",), "tool": ("tool",)}
ROLE_ORDER = ("human", "ai", "system", "tool", "unknown")

#: Names of chat export roles.
CHAT_ROLES = {
    "user": ("user", "human", "person", "customer", "client", "altair"),
    "assistant": ("assistant", "ai", "model", "ankaa", "chatgpt", "gpt"),
    "system": ("system",),
    "tool": ("tool", "browser", "search", "function", "shell", "mcp"),
}

#: Session and chunk sizes in characters.
SESSION_TARGET = {"small": 3800, "medium": 7600, "large": 13000}
CHUNK_SIZES = {"small": (120, 250, 420), "medium": (170, 390, 650), "large": (220, 530, 860)}

#: Chunk mentions, total mentions and concepts for each chunk.
CONCEPT_LIMITS = {"low": (3, 4, 0.3), "medium": (2, 3, 0.45), "high": (2, 2, 0.6)}

#: HTML elements that begin a new line.
BLOCK_TAGS = (
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td th thead tr ul"
).split()
#: HTML elements that are left out whole.
SKIPPED_TAGS = ("script", "style", "noscript", "template")

#: Words that tell a chunk's kind, in order of precedence (quote comes before fact).
KIND_CUES = {
    "error": "error|failed|failure|exception|traceback|bug",
    "decision": "decision|decide|decided|approved|final|resolved|ship(?:ped)?",
    "request": "please|could you|can you|would you|need to|request|ask",
    "task": "todo|next step|action item|follow up",
    "fact": "is|means|defined as|consists of",
}
#: Shapes of artifacts, declarations and headings, and words that open a new thought.
TABLE_SHAPE = r"(?i)(?<![a-z0-9_])[a-z0-9_]+\s*,\s*[a-z0-9_]+\s*,\s*[a-z0-9_]+"
JSON_SHAPES = (r"^[\[{]", r'"[^"\\]{1,40}"\s*:')
SECTION_SHAPES = (r"(?i)^(?:#{1,6}\s+)?(?:chapter|section|part|appendix)(?![a-z0-9_])", r"^[A-Z0-9][A-Z0-9\s:._\-/]{6,90}\z")
DECLARATION = r"(?<![A-Za-z0-9_])(?:function|class|interface|type|const|let|var|export\s+function|export\s+class)\s+([A-Za-z_][A-Za-z0-9_]*)"
JSON_KEY = r'"([^"\\]{1,40})"\s*:'
HEADING = r"(?i)^(?:#{1,6}\s+)?((?:chapter|section|part|appendix)\s+[A-Za-z0-9._:-]+[^.!?\n]{0,80})"
CUE = r"(?<![a-z0-9_])(?:(?:however|therefore|in summary|finally|next step|conclusion)(?![a-z0-9_])|next,(?=[a-z0-9_]))"

#: Labels that are no topic.
DISCOURAGED_LABELS = (
    "assistant, assistants, chatgpt, chunk, chunks, concept, concepts, conversation, conversations, file, files, json, local memory, manifest, "
    "message, messages, prompt, prompts, session, sessions, text, textpack, thread, threads, user, users"
).split(", ")

#: Glyph families in order, with the keywords that count for them.
GLYPHS = {
    "artifact": ("⧉", ("code", "table", "json", "artifact", "document section", "schema")),
    "architecture": ("⟁", ("architecture", "project", "design", "system", "module", "component")),
    "change": ("∆", ("change", "edit", "update", "modify", "patch", "refactor")),
    "recurrence": ("⟲", ("again", "repeat", "loop", "recurring", "iteration", "revisit")),
    "summary": ("∑", ("summary", "dataset", "aggregate", "overview", "index", "manifest")),
    "procedure": ("λ", ("procedure", "function", "transform", "step", "script", "process")),
    "conflict": ("⊗", ("error", "failure", "conflict", "bug", "exception", "issue")),
    "merge": ("⊕", ("merge", "support", "dependency", "integrate", "compatible")),
    "decision": ("Ω", ("decision", "final", "done", "terminal", "ship", "resolved")),
    "abstract": ("∞̇", ("theory", "abstract", "framework", "model", "principle", "semantic")),
}

#: The palette of symbol glyphs.
SYMBOL_PALETTE = (
    "⟁ ∆ ⟲ ∑ λ ⊗ ⊕ Ω ⧉ ∞̇ "
    "∴ ∵ ∷ ≡ ≈ ≠ ≤ ≥ √ ∫ ∂ ∇ ∈ ∉ ⊂ ⊃ ⊆ ⊇ ∪ ∩ ∅ "
    "⋅ ∧ ∨ ¬ ⊢ ⊣ ⊤ ⊥ ⌒ ⌘ ⌠ ⌡ ⎵ ⎶ "
    "─ │ ┌ ┐ └ ┘ ├ ┤ ┬ ┴ ┼ ═ ║ ╒ ╓ ╔ ╕ ╖ ╗ ╘ ╙ "
    "╚ ╛ ╜ ╝ ╞ ╟ ╠ ╡ ╢ ╣ ╤ ╥ ╦ ╧ ╨ ╩ ╪ ╫ ╬ "
    "▀ ▄ █ ▌ ▐ ░ ▒ ▓ ■ □ ▲ △ ▼ ▽ ◆ ◇ ○ ● ◐ ◑ ◒ ◓ "
    "◢ ◣ ◤ ◥ ☀ ☁ ☂ ★ ☆ ☎ ☕ ☠ ☢ ☣ ☦ ☮ ☯ ☹ ☺ ♠ ♣ ♥ ♦ "
    "⚀ ⚁ ⚂ ⚃ ⚄ ⚅ ✁ ✂ ✆ ✈ ✉ ✌ ✎ ✓ ✔ ✖ ✗ ✝ ✠ ✡ "
    "✳ ✴ ✵ ✶ ✷ ✸ ✹ ✺ ✻ ✼ ✽ ❖ ❗ ❤ ❶ ❷ ❸ ❹ ❺ ❻ ❼ ❽ ❾ ❿ "
    "➔ ➡ ➳ ➵ ➸ ➺ ⬅ ⬆ ⬇ ⬛ ⬜ ⭐ ⭕"
).split()
