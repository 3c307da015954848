"""Snippets that each lint rule hits or passes by, for the query over all rules and for tests."""

HMAC = "const h = crypto.createHmac('sha256', s)"
#: For each rule snippets, and the line that it hits or None.
CASES = {
    1: [(f"{HMAC}.update(JSON.stringify(req.body))", 1), (f"{HMAC}.update(req.rawBody)", None), (f"// {HMAC}.update(JSON.stringify(req.body))", None)],
    2: [(f"{HMAC}\nif (signature === expected) {{}}", 2), (f"{HMAC}\nif (crypto.timingSafeEqual(a, b)) {{ digest == x }}", None), ("signature === expected", None)],
    3: [("const o = { amount: 500, currency: 'INR' }", 1), ("const o = { amount: 500 * 100, currency: 'INR' }", None), ("const o = { amount: 50000, currency: 'INR' }", None), ("const o = { amount: 500, currency: 'USD' }", None)],
    4: [("x = 1\nclient.payments.create({})", 2), ("client.orders.create({})\nclient.payments.create({})", None), ("client.payments.create({})\nclient.orders.create({})", 1)],
    5: [("const k = 'acme_live_ABCDEFGHIJKLMN'", 1), ("const k = 'acme_live_ABC'", None), ("// acme_live_ABCDEFGHIJKLMN\nconst a = 1", None)],
    6: [("const k = 'acme_test_ABCDEFGHIJKLMN'", 1), ("const k = process.env.K", None)],
    7: [("const o = { payment_capture: 0 }", 1), ("const o = { payment_capture: 0 }\nclient.payments.capture(id)", None), ("client.payments.capture(id)\nconst o = { payment_capture: 0 }", 2)],
    8: [("const a = 1\nclient.payments.refund(id)", 2), ("client.payments.refund(id, {}, { headers: { 'Idempotency-Key': k } })", None)],
    9: [("console.log(cvv)", 1), ("client.tokens.create({ cvv })", None), ("const a = 1 // save cvv", None)],
    10: [("const a = '4111111111111111'", 1), ("db.cards.insert({ card_number })", 1), ("const a = '411111111111111'", None)],
    11: [("const u = 'https://a.b:8080/x/webhook'", 1), ("const u = 'https://a.b:443/x/webhook'", None)],
    12: [("const a = { currency: 'INR' }\nconst b = { currency: 'USD' }", 1), ("const a = { currency: 'INR' }\nconst b = { currency: 'inr' }", None)],
    13: [("const s = client.subscriptions.create({ addons: x })", 1), ("const s = client.subscriptions.create({ addons: schema.parse(x) })", None), ("const s = client.subscriptions.create({ plan })", None)],
    14: [("const p = { method: 'upi' }", 1), ("const p = { method: 'upi', callback_url: u }", None)],
    15: [("const p = client.paymentLink.create({ a })", 1), ("const p = client.paymentLink.create({ expire_by: 1 })", None)],
    16: [("const b = payment_id + '|' + order_id", 1), ("const b = order_id + '|' + payment_id", None)],
    17: [("const o = { notes: {\n a: { b: 1 },\n c: '" + "x" * 257 + "' } }", 3), ("const o = { notes: { a: 'b' }, c: '" + "x" * 300 + "' }", None), ("const o = { notes: { a: '" + "x" * 300 + "'", None)],
    18: [("const o = { receipt: '" + "r" * 41 + "' }", 1), ("const o = { receipt: '" + "r" * 40 + "' }", None)],
    19: [("const k = 'acme_test_ABCDEFGH'\nif (process.env.NODE_ENV === 'production') {}", 1), ("const k = 'acme_test_ABCDEFGH'", None)],
    20: [("// x\nif (e === 'payment.captured') {\n res.status(500).send('x')\n}", 3), ("if (e === 'payment.captured') {\n if (!ok) {\n res.status(400).end()\n}}", None), ("if (e === 'payment.captured') {\n res.status(400).json({ error })\n}", None), ("res.status(500).send('x')", None)],
    21: [("app.post('/webhook', (req) => {})", 1), ("app.post('/webhook', (req) => { if (seenEvents.has(e)) return })", None), ("const webhook = 1", None)],
    22: [("const a = { currency: 'inr' }", 1), ("const a = { currency: 'INR' }", None)],
    23: [("window.x = 1; const a = key_secret", 1), ("const a = key_secret", None)],
    24: [("const partnerCode = 1", 1), ("const partnerCode = 1; h['X-Acme-Account'] = a", None)],
    25: [("const r = { recurring: 'preferred', auth_amount: 1500001 }", 1), ("const r = { recurring: 'preferred', auth_amount: 1500000 }", None)],
    26: [("setTimeout(() => client.payments.capture(id), 6 * 24 * 60 * 60 * 1000)", 1), ("setTimeout(() => client.payments.capture(id), 4 * 24 * 60 * 60 * 1000)", None)],
    27: [("const r = client.refunds.create({ a })", 1), ("const r = client.refunds.create({ speed: 'normal' })", None)],
    28: [("const webhook_secret = req.headers['s']", 1), ("const webhook_secret = process.env.S", None)],
    29: [("const o = { receipt: `${Date.now()}` }", 1), ("const o = { receipt: `${Date.now()}_${crypto.randomUUID()}` }", None)],
    30: [('{ "acme": "^1.2.3" }', 1), ('{ "acme": "^2.2.3" }', None)],
}
