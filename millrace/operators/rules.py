"""The lint catalog: 30 rules about payment code, each a column expression over a snippet."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import column_of, let, line_of, matches, no_matches, pieces_of, placed, rx
from .source_code import named

SNIPPET = 240
RUN = 6
FOUND = "__found"
HITS = "array<struct<line:int,column:int,snippet:string>>"
SEVERITIES = ("error", "warning", "info")


@dataclass(frozen=True)
class Code:
    """Columns of one snippet, and the vendor's names.

    Patterns that rules look for are noted, and found() refers to a column that located() makes of all of them: their
    offsets are then told by one expression, and the plan stays small enough to be made in little time.
    """

    code: Column
    masked: Column
    lines: Column
    masked_lines: Column
    brand: str
    key: str
    bits: Column
    #: The bits of which a snippet needs one for the rule at hand; None if it needs none.
    needed: int | None = None
    #: Pattern and group to the bits of all rules that look for it.
    noted: dict[tuple[str, int], int | None] = field(default_factory=dict)

    def rx(self, pattern: str, flags: str = "") -> str:
        return rx(named(pattern, self.brand, self.key), flags)

    def has(self, pattern: str, flags: str = "") -> Column:
        return self.masked.rlike(self.rx(pattern, flags))

    def found(self, pattern: str, flags: str = "", group: int = 0) -> Column:
        asked = (self.rx(pattern, flags), group)
        before = self.noted.get(asked, 0)
        self.noted[asked] = None if before is None or self.needed is None else before | self.needed
        return F.get(F.col(FOUND), F.lit(list(self.noted).index(asked)))

    def wanted(self, needed: int | None) -> Column:
        return F.lit(True) if needed is None else self.bits.bitwiseAND(F.lit(needed)) != 0

    def located(self) -> Column:
        """For each noted pattern its matches in the masked code: none where no rule that looks for it is tried."""
        text = F.coalesce(self.masked, F.lit(""))
        kind = "struct<first:int,hits:array<string>,parts:array<string>,gaps:array<int>>"
        pieces = [(needed, F.when(self.wanted(needed), pieces_of(text, p, group))) for (p, group), needed in self.noted.items()]
        if not pieces:
            return F.array().cast("array<array<struct<start:int,hit:string,part:string>>>")
        runs = self.gated(pieces, lambda n: F.array(*[F.lit(None).cast(kind)] * n))
        return F.transform(F.flatten(runs), lambda x: F.when(x.isNotNull(), placed(x)).otherwise(no_matches()))

    def gated(self, xs: list[tuple[int | None, Column]], without: Callable[[int], Column]) -> Column:
        """An array of arrays, one for each run of RUN entries: a run whose bits a text lacks altogether costs one comparison."""

        def run(part: list[tuple[int | None, Column]]) -> Column:
            bits = [needed for needed, _ in part]
            on = self.wanted(None if None in bits else reduce(or_, bits))
            return F.when(on, F.array(*[x for _, x in part])).otherwise(without(len(part)))

        return F.array(*[run(xs[i : i + RUN]) for i in range(0, len(xs), RUN)])

    def first(self, pattern: str, flags: str = "") -> Column:
        """Offset of the first match in code points, null without one."""
        return F.get(self.found(pattern, flags), F.lit(0))["start"]

    def around(self, hit: Column, before: int, after: int) -> Column:
        start = F.greatest(hit["start"] - before, F.lit(0))
        return F.substring(self.masked, start + 1, hit["start"] + after - start)


Detector = Callable[[Code], Column]


def hit_at(line: Column, snippet: Column, column: Column | None = None) -> Column:
    return F.struct(line.cast("int").alias("line"), (F.lit(1) if column is None else column).cast("int").alias("column"), F.substring(snippet, 1, SNIPPET).alias("snippet"))


def _none() -> Column:
    return F.array().cast(HITS)


def _all(c: Code, found: Column, said: Callable[[Column], Column] | None = None) -> Column:
    return F.transform(found, lambda h: hit_at(line_of(c.code, h["start"]), h["hit"] if said is None else said(h)))


def _one(c: Code, anchor: str, flags: str, said: str, when: Column) -> Column:
    """One hit at the first match of an anchor, if a condition on the whole snippet holds."""
    return F.when(when & c.has(anchor, flags), F.array(hit_at(line_of(c.code, c.first(anchor, flags)), F.lit(said)))).otherwise(_none())


def pattern(p: str, flags: str = "") -> Detector:
    """Every match, with its column."""
    return lambda c: F.transform(c.found(p, flags), lambda h: hit_at(line_of(c.masked, h["start"]), h["hit"], column_of(c.masked, h["start"])))


def lacking(p: str, hint: str, before: int, after: int, flags: str = "", needs: tuple[str, str] | None = None) -> Detector:
    """Every match without a hint around it (and with what it needs there)."""

    def detect(c: Code) -> Column:
        def stays(h):
            near = c.around(h, before, after)
            ok = ~near.rlike(c.rx(hint, flags))
            return ok & near.rlike(c.rx(*needs)) if needs else ok

        return _all(c, F.filter(c.found(p), stays))

    return detect


# Patterns of the rules. <Brand>, <brand>: the vendor's name; <key>, <KEY>: the prefix of its keys.
_CURRENCY = r"\bcurrency\s*[:=]\s*[\"'`]([A-Za-z]{3})[\"'`]"
_AMOUNT = r"\bamount\s*[:=]\s*([0-9]+(?:\.\d+)?)"
_TIMES_100, _PAISE = r"\*\s*100(?!\d)", r"in\s*paise|paise\b"
_PAY_CREATE = r"\b(?:payments?\.create|payment\.create|payments\(\)\.create|payment\(\)\.create)\b"
_ORDER_CREATE = r"\b(?:orders?\.create|order\.create|orders\(\)\.create|order\(\)\.create|client\.order\.create)\b"
_RECEIPT = r"\breceipt\s*[:=]\s*[\"'`]([^\"'`\n]+)[\"'`]"
_RECEIPT_TIME = (
    r"\breceipt\s*[:=]\s*[`\"']?\s*\$?\{?\s*Date\.now\s*\(\s*\)",
    r"\breceipt\s*[:=]\s*[`\"']?\s*\$?\{?\s*time\s*\(\s*\)",
    r"\breceipt\s*[:=]\s*[`\"']?\s*\$?\{?\s*new\s+Date\s*\(",
    r"\breceipt\s*[:=]\s*[`\"']?\s*\$?\{?\s*time\.time\s*\(\s*\)",
)
_NONCE = r"(?:randomUUID|uuid|crypto\.random|Math\.random|nanoid|shortid|secrets\.token|nonce|random_int|bin2hex|random_bytes)"
_REFUND = r"\b(?:refunds?\.create|refund\.create|create_refund|createRefund|payments?\.refund|payment_id\.refund)\s*\("
_REFUND_CALL = r"\b(?:refunds?\.create|payments?\.refund|createRefund|create_refund)\s*\("
_IDEMPOTENT = r"Idempotency[-_]?Key|X[-_]?<Brand>[-_]?Idempotency|setIdempotencyKey"
_HOOK = r"(x-<brand>-signature|<brand>-signature|webhook(?:_event|Event)?|payment\.captured|order\.paid|invoice\.paid)"
_DEDUPED = r"\b(?:event\.id|payload\.payment\.entity\.id|event_id|webhook_id)\b[\s\S]{0,200}?\b(?:exists|seen|processed|insertOne|insertIfMissing|insertIgnore|insertIgnoring|find|findOne|select|cache|redis|memcache|getSet|setnx|on conflict)"
_DEDUPED_NAMES = r"\b(?:processedEvents|seenEvents|alreadyProcessed|isDuplicate|insertIfMissing)\b"
_HOOK_ENTRY = r"\b(?:app\.(?:post|use)|router\.post|@app\.route|def\s+\w*webhook|function\s+\w*webhook|public\s+\w+\s+handle\w*Webhook)"
_LIVE_KEY, _TEST_KEY, _TEST_KEY_SHORT = r"\b<key>_live_[A-Za-z0-9]{14,}\b", r"\b<key>_test_[A-Za-z0-9]{14,}\b", r"\b<key>_test_[A-Za-z0-9]{8,}"
_PRODUCTION = r"(?:NODE_ENV\s*[!=]==?\s*[\"'`]production[\"'`])|(?:[\"'`]production[\"'`]\s*[!=]==?\s*[\w.]*?NODE_ENV)|(?:env\s*\(\s*[\"']APP_ENV[\"']\s*\)\s*[!=]==?\s*[\"']production[\"'])|(?:RAILS_ENV\s*[!=]==?\s*[\"']production[\"'])|(?:os\.environ.{0,40}[\"']production[\"'])"
_BROWSER = r"\b(?:window\.|document\.|<script\b|useState\b|useEffect\b|React\.|export\s+default\s+function\s+\w+\s*\(\s*\)\s*\{[\s\S]{0,120}?return\s*<|\"use client\"|'use client'|new\s+<Brand>Checkout)\b"
_SECRETS = r"\b(?:key_secret|<KEY>_KEY_SECRET|<brand>_secret|secret_key)\b"
_CVV = r"\b(cvv|cvc|card_code|cardCvv|cardCode|card_security_code)\b"
_PERSIST = r"(?:\b(?:save|insert|update|store|persist|writeFile|appendFile)\b|\bconsole\.(?:log|info|warn|error|debug)\b|\bdb\.[a-z_]+\.(?:save|insert|update|create|upsert)\b|\bprisma\.[a-z_]+\.(?:create|update|upsert)\b|\blogger\.(?:log|info|warn|error|debug)\b)"
_PAN = r"\b(?:4\d{15}|5[1-5]\d{14}|3[47]\d{13}|6(?:011|5\d{2})\d{12})\b"
_PAN_DIGITS = r"[0-9]{15}"  # the shortest number that _PAN knows
_PAN_NAME = r"\b(card_?number|pan|full_card|cardNumber|card_no)\b"
_PORT = r"https?://[A-Za-z0-9.-]+:(?!80\b|443\b)(\d{2,5})/[A-Za-z0-9._~/?%#=&-]*(?:webhook|hooks?|notify|payment|callback)\b[A-Za-z0-9._~/?%#=&-]*"
_HANDLER = r"(x-<brand>-signature|<brand>-signature|payment\.captured|order\.paid|webhook(?:_event)?|verifyWebhookSignature)"
_ERROR_REPLY = r"\b(?:res\.status\(\s*(?:[45]\d\d)\s*\)\s*\.(?:send|json|end)|return\s+(?:status\s*\(\s*[45]\d\d\)|HttpResponse\(\s*status\s*=\s*[45]\d\d|new\s+ResponseEntity\(\s*HttpStatus\.[A-Z_]+\b))"
_ERROR_LINE, _ERROR_BRANCH = r"(?:invalid|fail|error|unauthorized|forbidden|signature|verify|verification)", r"if\s*\(\s*!|verify|signature"
_NO_CAPTURE = r"\bpayment_capture\s*[:=]\s*(?:0|false|\"0\"|'0')"
_CAPTURE = r"\b(?:payments?\.capture|payment\.capture|capturePayment|capture_payment|\.capture\s*\()"
_DELAYS = (
    r"setTimeout\s*\([\s\S]{0,200}?\b([5-9]|[1-9]\d+)\s*\*\s*24\s*\*\s*60\s*\*\s*60\s*\*\s*1000",
    r"\b([5-9]|[1-9]\d+)\s*(?:d|day|days)\b",
    r"Date\.now\s*\(\s*\)\s*-[\s\S]{0,100}?\b([5-9]|[1-9]\d+)\s*\*\s*24\s*\*\s*60\s*\*\s*60\s*\*\s*1000",
)
_SUBSCRIBE, _ADDONS = r"\bsubscriptions?\.create\s*\(", r"\baddons\s*[:=]"
_VALIDATED = r"(?:zod\.|\.parse\(|joi\.|Joi\.|validate|schema\.|assert|isInteger|isFinite|typeof\s+\w+\s*===|in_array|array_key_exists)"
_UPI = r"\b(?:method\s*[:=]\s*['\"`]upi['\"`]|\"flow\"\s*:\s*\"intent\"|flow\s*[:=]\s*['\"`]intent['\"`])"
_UPI_ANCHOR = r"\b(?:method\s*[:=]\s*['\"`]upi['\"`]|flow\s*[:=]\s*['\"`]intent['\"`])"
_LINK = r"\b(?:paymentLink|paymentLinks|payment_links|payment_link)\.create\s*\("
_NOTES, _LONG_VALUE = r"\bnotes\s*[:=]\s*\{", r"[\"'`]([^\"'`]{257,})[\"'`]"
_PARTNER, _ACCOUNT = r"\b(?:partner|sub_?merchant|linked[_\s-]?account|aggregator)", r"X[-_]?<Brand>[-_]?Account"
_RECURRING, _AUTH = r"\brecurring\s*[:=]\s*['\"`]preferred['\"`]", r"\bauth_?amount\s*[:=]\s*([0-9]+)"
_SPEED = r"\bspeed\s*[:=]\s*['\"`](?:normal|optimum|instant)['\"`]"
_SDK = r"\"<brand>\"\s*:\s*\"[\^~]?(?:0|1)\.\d+\.\d+(?:[-+][\w.]+)?\""
_STRINGIFIED = r"(?:createHmac|hash_hmac|HmacSHA256|new\s+Mac|hmac\.new)[\s\S]{0,200}?(?:JSON\.stringify\s*\(\s*(?:req\.body|request\.body|body|payload)|json_encode\s*\(\s*\$_(?:POST|REQUEST))"
_HMAC, _CONSTANT_TIME = r"(createHmac|hash_hmac|HmacSHA256|hmac\.new|new\s+Mac)", r"(timingSafeEqual|hash_equals|MessageDigest\.isEqual|hmac\.compare_digest)"
_COMPARED = r"\b(?:signature|expected|digest|hmac|computed|hash)\b.*?(===|==)\s*[A-Za-z_$]"
_WRONG_ORDER = r"(?:<brand>_)?payment_id[^|\"'`]{0,40}[\"'`|+\s.${},]+(?:<brand>_)?order_id"
_ASKED_SECRET = r"\b(?:secret|webhook_secret|webhookSecret)\s*[:=]\s*(?:req\.headers|req\.query|req\.body|request\.headers|request\.query|request\.json|request\.args|\$_(?:GET|POST|REQUEST|HEADERS))"


def _currencies(c: Code) -> Column:
    return F.array_distinct(F.transform(c.found(_CURRENCY, group=1), lambda h: F.upper(h["part"])))


def _rupees(c: Code) -> Column:
    def stays(h):
        near = c.around(h, 120, 200)
        return h["part"].try_cast("double").between(1, 9999) & ~near.rlike(c.rx(_TIMES_100)) & ~near.rlike(c.rx(_PAISE, "i"))

    return F.when(F.array_contains(_currencies(c), "INR"), _all(c, F.filter(c.found(_AMOUNT, group=1), stays))).otherwise(_none())


def _two_currencies(c: Code) -> Column:
    first = c.first(_CURRENCY)
    said = lambda codes: F.array(hit_at(line_of(c.code, first), F.concat(F.lit("currencies: "), F.array_join(codes, ", "))))
    several = let(_currencies(c), lambda codes: F.when(F.size(codes) >= 2, said(codes)).otherwise(_none()))
    return F.when(F.size(c.found(_CURRENCY, group=1)) >= 2, several).otherwise(_none())


def _no_order(c: Code) -> Column:
    order, pay = (F.regexp_instr(c.masked, F.lit(c.rx(p))) for p in (_ORDER_CREATE, _PAY_CREATE))
    late = F.array(hit_at(line_of(c.code, c.first(_PAY_CREATE)), F.lit("the payment is created before its order")))
    return F.when(order == 0, _all(c, c.found(_PAY_CREATE))).when((pay > 0) & (order > pay), late).otherwise(_none())


def _long_receipt(c: Code) -> Column:
    return _all(c, F.filter(c.found(_RECEIPT, group=1), lambda h: F.length(h["part"]) > 40), lambda h: F.concat(F.lit("receipt of "), F.length(h["part"]).cast("string"), F.lit(" characters: "), F.substring(h["part"], 1, 60)))


def _receipt_of_time(c: Code) -> Column:
    return F.concat(*[lacking(p, _NONCE, 0, 220, "i")(c) for p in _RECEIPT_TIME])


def _not_deduped(c: Code) -> Column:
    return _one(c, _HOOK_ENTRY, "i", "a webhook handler that doesn't look for repeated events", c.has(_HOOK, "i") & ~c.has(_DEDUPED, "i") & ~c.has(_DEDUPED_NAMES))


def _test_key_in_production(c: Code) -> Column:
    return _one(c, _TEST_KEY_SHORT, "", "a test key beside a production guard", c.has(_PRODUCTION, "i"))


def _secret_in_browser(c: Code) -> Column:
    return F.when(c.has(_BROWSER), _all(c, c.found(_SECRETS))).otherwise(_none())


def _lines(c: Code, test: Callable[[Column], Column], masked: bool = True) -> Column:
    rows = F.zip_with(c.masked_lines if masked else c.lines, c.lines, lambda m, o: F.struct(m.alias("m"), o.alias("o")))
    rows = F.transform(rows, lambda x, i: F.struct((i + 1).alias("n"), x["m"].alias("m"), x["o"].alias("o")))
    return F.transform(F.filter(rows, lambda x: test(F.coalesce(x["m"], F.lit("")))), lambda x: hit_at(x["n"], F.trim(F.coalesce(x["o"], F.lit("")))))


def _plain_compare(c: Code) -> Column:
    on = c.has(_HMAC) & ~c.has(_CONSTANT_TIME)
    return F.when(on, _lines(c, lambda x: x.rlike(c.rx(_COMPARED, "i")), masked=False)).otherwise(_none())


def _cvv(c: Code) -> Column:
    on = c.has(_PERSIST, "i")
    return F.when(on, _lines(c, lambda x: x.rlike(c.rx(_CVV, "i")) & x.rlike(c.rx(_PERSIST, "i")))).otherwise(_none())


def _pan(c: Code) -> Column:
    """Lines are looked at only in a text that somewhere has digits enough for a number, or both of the words."""
    on = c.has(_PAN_DIGITS) | (c.has(_PAN_NAME, "i") & c.has(_PERSIST, "i"))
    return F.when(on, _lines(c, lambda x: x.rlike(c.rx(_PAN)) | (x.rlike(c.rx(_PAN_NAME, "i")) & x.rlike(c.rx(_PERSIST, "i"))))).otherwise(_none())


def _error_reply(c: Code) -> Column:
    def stays(h):
        head = F.substring(c.masked, F.lit(1), h["start"])
        rest = F.substring_index(F.substring(c.masked, h["start"] + 1, F.length(c.masked)), "\n", 1)
        line = F.concat(F.substring_index(head, "\n", -1), rest)
        before = F.coalesce(F.try_element_at(F.split(head, "\n", -1), F.lit(-2)), F.lit(""))
        return ~line.rlike(c.rx(_ERROR_LINE, "i")) & ~before.rlike(c.rx(_ERROR_BRANCH, "i"))

    return F.when(c.has(_HANDLER, "i"), _all(c, F.filter(c.found(_ERROR_REPLY), stays))).otherwise(_none())


def _never_captured(c: Code) -> Column:
    after = lambda h: F.substring(c.masked, h["start"] + 1, F.length(c.masked))
    return _all(c, F.filter(c.found(_NO_CAPTURE), lambda h: ~after(h).rlike(c.rx(_CAPTURE + r"\b"))))


def _late_capture(c: Code) -> Column:
    near = lambda h: c.around(h, 400, 400).rlike(c.rx(_CAPTURE))
    return F.when(c.has(_CAPTURE), F.concat(*[_all(c, F.filter(c.found(p), near)) for p in _DELAYS])).otherwise(_none())


def _upi(c: Code) -> Column:
    return _one(c, _UPI_ANCHOR, "i", "a UPI intent flow without callback_url", c.has(_UPI, "i") & ~c.has(r"\bcallback_url\b", "i"))


def _partner(c: Code) -> Column:
    return _one(c, _PARTNER, "i", "a partner integration without the account header", ~c.has(_ACCOUNT, "i"))


def _auth_amount(c: Code) -> Column:
    big = F.filter(c.found(_AUTH, group=1), lambda h: h["part"].try_cast("double") > 1500000)
    return F.when(c.has(_RECURRING), _all(c, big, lambda h: F.concat(F.lit("auth_amount "), h["part"], F.lit(" paise")))).otherwise(_none())


def _long_notes(c: Code) -> Column:
    """String values of over 256 characters between the braces of notes. Only brace characters are folded over."""

    def inside(h):
        start = h["start"] + F.length(h["hit"])
        rest = F.substring(c.masked, start + 1, F.length(c.masked))
        zero = F.struct(F.lit(1).alias("depth"), F.lit(-1).alias("end"))

        def step(acc, b):
            depth = acc["depth"] + F.when(b["hit"] == "{", 1).otherwise(-1)
            closed = F.struct(F.lit(0).alias("depth"), b["start"].alias("end"))
            return F.when(acc["end"] >= 0, acc).when(depth == 0, closed).otherwise(F.struct(depth.alias("depth"), acc["end"].alias("end")))

        close = F.aggregate(matches(rest, "[{}]"), zero, step, lambda acc: acc["end"])
        body = F.substring(rest, F.lit(1), close)
        said = F.transform(matches(body, _LONG_VALUE, 1), lambda v: hit_at(line_of(c.code, start + v["start"]), F.concat(F.lit("notes value of "), F.length(v["part"]).cast("string"), F.lit(" characters"))))
        return F.when(rest.rlike(_LONG_VALUE) & (close >= 0), said).otherwise(_none())

    return F.flatten(F.transform(c.found(_NOTES), inside))


@dataclass(frozen=True)
class Rule:
    """One rule. concern groups rules; the citation is a route of the corpus, perhaps with a section."""

    id: str
    severity: str
    concern: str
    title: str
    route: str
    excerpt: str
    fix: str
    detect: Detector
    section: str | None = None
    languages: tuple[str, ...] = ("*",)
    #: A hit needs one of these in the masked code, in lower case; without any the rule is always tried.
    triggers: tuple[str, ...] = ()


#: What each rule's patterns can't match without, in lower case. Rule 10 also hits bare numbers, so it has none.
TRIGGERS = {
    1: ("mac",), 2: ("mac",), 3: ("amount",), 4: ("payment",), 5: ("_live_",), 6: ("_test_",), 7: ("payment_capture",), 8: ("refund",),
    9: ("cvv", "cvc", "card_code", "cardcode", "card_security_code"), 11: ("://",), 12: ("currency",), 13: ("subscription",), 14: ("upi", "intent"), 15: ("payment",),
    16: ("payment_id",), 17: ("notes",), 18: ("receipt",), 19: ("_test_",), 20: ("status",), 21: ("signature", "webhook", "payment.captured", "order.paid", "invoice.paid"),
    22: ("currency",), 23: ("secret",), 24: ("partner", "merchant", "linked", "aggregator"), 25: ("recurring",), 26: ("capture",), 27: ("refund",), 28: ("secret",), 29: ("receipt",), 30: ('"<brand>"',),
}


def _r(n, severity, concern, title, route, excerpt, fix, detect, section=None) -> Rule:
    return Rule(f"L{n:03d}", severity, concern, title, route, excerpt, fix, detect, section, triggers=TRIGGERS.get(n, ()))


def triggered(low: Column, rules: tuple[Rule, ...], brand: str, key: str) -> Column:
    """A number with a bit for each distinct trigger of the rules that a text in lower case has; the bits are those of trigger_mask()."""
    out = F.lit(0).cast("long")
    for t, bit in trigger_bits(rules).items():
        out = out + F.when(F.contains(low, F.lit(named(t, brand, key).lower())), F.lit(bit)).otherwise(F.lit(0))
    return out


def trigger_bits(rules: tuple[Rule, ...]) -> dict[str, int]:
    return {t: 1 << i for i, t in enumerate(sorted({t for r in rules for t in r.triggers}))}


def trigger_mask(rule: Rule, rules: tuple[Rule, ...]) -> int | None:
    """The bits of which a text needs one for the rule; None if it needs none."""
    bits = trigger_bits(rules)
    return sum(bits[t] for t in rule.triggers) if rule.triggers else None


# Ids, severities, concerns, and the routes and sections that the rules cite. Titles and texts are this library's own.
RULES: tuple[Rule, ...] = (
    _r(1, "error", "webhook_signature", "The webhook's HMAC is made of a body that was serialised again", "webhooks/validate-test", "The signature is of the raw bytes of the request.", "Keep the raw body and hash that.", pattern(_STRINGIFIED)),
    _r(2, "error", "webhook_signature", "A signature is compared in a way that timing gives away", "webhooks/validate-test", "Compare signatures in constant time.", "Use timingSafeEqual, hash_equals, MessageDigest.isEqual or compare_digest.", _plain_compare),
    _r(3, "warning", "amount_handling", "An amount looks like rupees, not paise", "api/orders/create", "Amounts are in the currency's smallest unit.", "Multiply rupees by 100.", _rupees),
    _r(4, "error", "order_flow", "A payment is created without an order before it", "api/orders/create", "A payment belongs to an order.", "Create the order first and pass its id on.", _no_order),
    _r(5, "error", "key_safety", "A live key stands in the code", "payments/dashboard/account-settings/api-keys", "Live keys are never committed.", "Read it from the environment and have it replaced.", pattern(_LIVE_KEY)),
    _r(6, "info", "key_safety", "A test key stands in the code", "payments/dashboard/account-settings/api-keys", "Test keys belong to an account, too.", "Read it from the environment.", pattern(_TEST_KEY)),
    _r(7, "warning", "capture", "Capture is turned off and no capture follows", "api/payments/capture", "An authorised payment must be captured.", "Capture automatically, or call capture later.", _never_captured),
    _r(8, "warning", "idempotency", "A refund has no idempotency key", "api/refunds/normal-refunds-idempotent", "A repeated request must not refund twice.", "Send a key of its own with each attempt.", lacking(_REFUND, _IDEMPOTENT, 300, 300, "i")),
    _r(9, "error", "pci_compliance", "A card's security code is stored or logged", "security/checklist", "Security codes may not be kept.", "Pass it on and keep only the token.", _cvv),
    _r(10, "error", "pci_compliance", "A full card number is stored or logged", "security/checklist", "Card numbers may not be kept in the clear.", "Keep only the token.", _pan),
    _r(11, "warning", "webhook_handler", "A webhook url has an unusual port", "webhooks/setup-edit-payments", "Webhooks go to ports 80 and 443.", "Put a proxy on 443.", pattern(_PORT, "i")),
    _r(12, "error", "currency", "Different currencies are declared", "api/orders", "A payment has its order's currency.", "Declare the currency once.", _two_currencies),
    _r(13, "warning", "payment_methods", "A subscription's addons aren't validated", "payments/subscriptions", "Addons of a wrong shape are rejected.", "Check their shape first.", lacking(_SUBSCRIBE, _VALIDATED, 0, 600, "i", (_ADDONS, "i"))),
    _r(14, "warning", "payment_methods", "A UPI intent has no callback_url", "payments/payment-methods/upi", "The payer's app returns to callback_url.", "Set callback_url.", _upi),
    _r(15, "warning", "payment_methods", "A payment link never expires", "api/payments/payment-links/create-standard", "expire_by ends a link.", "Set expire_by.", lacking(_LINK, r"\bexpire_by\b", 0, 700)),
    _r(16, "error", "webhook_signature", "Payment id and order id are joined in the wrong order", "webhooks/validate-test", "The order id comes first.", "Sign order id, a bar, payment id.", pattern(_WRONG_ORDER, "i")),
    _r(17, "warning", "order_flow", "A value in notes has over 256 characters", "api/orders/create", "Values in notes have 256 characters at most.", "Keep the long text elsewhere.", _long_notes, "notes"),
    _r(18, "warning", "order_flow", "A receipt has over 40 characters", "api/orders/create", "A receipt has 40 characters at most.", "Use a short id.", _long_receipt, "receipt"),
    _r(19, "error", "key_safety", "A test key is used in production", "payments/dashboard", "Production needs live keys.", "Choose keys by environment.", _test_key_in_production),
    _r(20, "warning", "webhook_handler", "A webhook handler replies with an error where nothing failed", "webhooks/best-practices", "Any reply but 2xx is sent again.", "Acknowledge first, work later.", _error_reply),
    _r(21, "warning", "idempotency", "A webhook handler doesn't look for repeated events", "webhooks/best-practices", "Events can come twice.", "Keep event ids and skip known ones.", _not_deduped),
    _r(22, "warning", "currency", "A currency code is in lower case", "api", "Currency codes have three capitals.", "Write it in capitals.", pattern(r"\bcurrency\s*[:=]\s*[\"'`]([a-z]{3})[\"'`]")),
    _r(23, "error", "key_safety", "A secret is in code for the browser", "payments/dashboard/account-settings/api-keys", "Secrets stay on the server.", "Sign on the server.", _secret_in_browser),
    _r(24, "warning", "payment_methods", "A partner request doesn't name the account", "partners", "Partner requests carry the account header.", "Send the header.", _partner),
    _r(25, "error", "payment_methods", "A recurring payment's first amount is above the cap", "announcements/rbi-card-mandate-guidelines/recurring-payments", "The cap is 15,000 rupees.", "Stay below, or ask for another factor.", _auth_amount),
    _r(26, "warning", "capture", "A capture is planned after the time for it", "payments/payments/late-authorisation", "After five days a payment is void.", "Capture at once.", _late_capture),
    _r(27, "warning", "idempotency", "A refund doesn't state its speed", "api/refunds/create-instant", "speed sets when a refund arrives.", "Set speed.", lacking(_REFUND_CALL, _SPEED, 0, 600)),
    _r(28, "error", "webhook_signature", "A webhook's secret is taken from the request", "webhooks/setup-edit-payments", "The secret is the server's own.", "Read it from the environment.", pattern(_ASKED_SECRET, "i")),
    _r(29, "warning", "order_flow", "A receipt is only a time", "api/orders/create", "Receipts are unique.", "Add a random part.", _receipt_of_time),
    _r(30, "info", "key_safety", "An old version of the SDK is declared", "api/changelog", "Newer versions have fixes.", "Raise the version.", pattern(_SDK)),
)


def first_of_line(hits: Column) -> Column:
    """A rule's hits, the first of each line."""
    return let(F.transform(hits, lambda h: h["line"]), lambda lines: F.filter(hits, lambda h, i: F.array_position(lines, h["line"]) == i + 1))


def chosen(concern: str = "all", exclude: tuple[str, ...] = (), rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    ids = [r.id for r in rules]
    if len(set(ids)) < len(ids):
        raise ValueError(f"rule ids repeat: {sorted({i for i in ids if ids.count(i) > 1})}")
    if concern != "all" and concern not in {r.concern for r in rules}:
        raise ValueError(f"no rule has the concern {concern}")
    return tuple(r for r in rules if (concern == "all" or r.concern == concern) and r.id not in exclude)

