"""Sentences written by hand, apart from the generator that trains the trees: personal data stands in {kind|...}."""

SENTENCES = (
    "You can reach our office in Boston by phone at {phone|(617) 555-0142} until five.",
    "Tel. {phone|030 / 1234567}, montags bis freitags.",
    "Rufen Sie uns an: Telefon {phone|0711/2345678}.",
    "Appelez-nous au téléphone {phone|01 23 45 67 89} avant midi.",
    "Llame por teléfono al {phone|912 345 678} para reservar.",
    "Please call {phone|212-555-0187} and ask for Maria.",
    "Her mobile is {phone|415.555.0133}, the fax is {phone|415.555.0134}.",
    "Dial {phone|0044 20 7946 0018} from abroad.",
    "Call me on {phone|+44 20 7946 0958} tonight.",
    "My cell: {phone|6175550199}",
    "Write to {email|anna.meier (at) example (dot) org} for details.",
    "Contact: {email|j.smith [at] mail.example.com}.",
    "Send it to {email|info at example dot net} today.",
    "Mail {email|sales(at)shop.example.com} or {email|help@example.com}.",
    "Bitte schreiben Sie an {email|kontakt[at]beispiel[dot]de}.",
    "Écrivez à {email|marie.dupont@exemple.fr} pour plus d'informations.",
    "The server {ip|2001:db8:85a3::8a2e:370:7334} did not answer.",
    "Requests came from host {ip|fe80::1ff:fe23:4567:890a} all night.",
    "The address {ip|dead:beef::cafe} is reserved for tests.",
    "Ping {ip|192.168.0.17} first, then {ip|10.1.2.3}.",
    "He paid with card {card|4111 1111 1111 1111} at the counter.",
    "Visa {card|4012-8888-8888-1881} expires soon.",
    "The card {card|5555555555554444} was declined twice.",
    "Two cards, {card|4111111111111111} {card|4012888888881881}, were lost.",
    "Order 20231104 left the depot on 2023-11-05.",
    "See version 2.10.4 of the manual, page 1204-1210.",
    "The ISBN is 978-3-16-148410-0, the price 19.99.",
    "We met at the station at 10:30:15 and talked.",
    "Look at the garden. It was sunny at noon.",
    "Chapter 3.1.4 covers 1914-1918 and 1939-1945.",
    "Invoice 4500012345678 was paid on 12.03.2021.",
    "The population grew from 1200345 to 1890222 in ten years.",
    "Ticket 555-1234-9999 is closed, token 9f86d081884c7d659a2feaa0c55ad015 expired.",
    "Population: 3 500 000; area: 1 200 km; density: 2 900.",
    "Der Zug um 14:05 hatte 20 Minuten Verspätung.",
    "El capítulo 12 empieza en la página 345.",
)


def parsed(marked: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text without marks, and its spans."""
    text, spans = "", []
    while "{" in marked:
        before, _, rest = marked.partition("{")
        span, _, marked = rest.partition("}")
        kind, _, value = span.partition("|")
        text += before
        spans.append((kind, len(text), len(text) + len(value)))
        text += value
    return text + marked, spans
