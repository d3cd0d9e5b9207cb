"""A small labelled table for personal data: sentences with slots, and what fills the slots.

The words around the slots become the model's cue words; what fills them is known to it by shape alone.
"""

from __future__ import annotations

import re

FILLERS = {
    "name": (
        "Anna Keller", "James O'Neil", "María López", "Jean-Luc Moreau", "Wei Zhang", "Fatima Al-Sayed", "Lukas Vogt", "Emily R. Carter",
        "Pedro Álvarez", "Claire Dubois", "Thomas", "Sofia", "Ngozi Okafor", "Björn Östlund", "Hannah Schmidt-Weber", "Raj Patel",
    ),
    "email": (
        "anna.keller [at] example [dot] org", "j dot smith at mail dot example dot com", "marie (at) exemple (point) fr", "info(at)firma.de",
        "pedro arroba correo punto es", "lukas AT web DOT de", "k.vogt {at} uni {dot} edu", "sales @ shop.example.com", "tom_b at post dot net",
        "rosa.perez [arroba] tienda [punto] es", "h.weber [ät] verein [punkt] de", "paul arobase courriel point fr",
    ),
    "phone": (
        "(212) 555-0187", "212-555-0187", "030 1234567", "0049 30 901820", "01 42 68 53 00", "91 123 45 67", "0171/2345678", "555.010.9988",
        "1-800-555-0199", "(030) 90 18 20", "0800 123456", "415 555 0132", "06-12345678", "089 / 32168",
    ),
    "card": ("4111.1111.1111.1111", "5500/0000/0000/0004", "3400_000000_00009", "4012.8888.8888.1881"),
    "ip": ("2001:db8::1f:8a2e", "fe80::1ff:fe23:4567:890a", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "2a00:1450:4001:81b::200e"),
    "address": (
        "12 Main Street", "221B Baker Street, London", "Hauptstraße 15, 10115 Berlin", "14 rue de la Paix, 75002 Paris", "Calle Mayor 8, 28013 Madrid",
        "4500 Oak Avenue, Apt 3", "Am Markt 7", "9 Elm Road", "Gartenweg 22a, 80331 München", "77 boulevard Voltaire", "1600 Hill Drive",
    ),
    "id": (
        "078-05-1120", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "C01X00T47", "AB123456", "219-09-9999", "X1234567L",
        "FR14 2004 1010 0505 0001 3M02 606", "L898902C3", "ES91 2100 0418 4502 0005 1332",
    ),
}

SENTENCES = (
    "My name is {name} and I live at {address}.", "Please contact {name} at {email} for details.", "Write to {email} or call {phone}.",
    "You can reach me at {phone} after six.", "Call me on {phone}, {name} said.", "Tel: {phone}", "Phone: {phone} Fax: {phone}", "Mobile {phone}",
    "Write to {name} at {email} soon.", "Ask {email} about it, please.", "Email: {email}", "E-mail {email}", "Mail me: {email}, thanks.", "Contact: {email}", "Name: {name}", "Name: {name}, Address: {address}, Phone: {phone}",
    "Address: {address}", "Send the parcel to {name}, {address}.", "She moved to {address} last year.", "Dear {name},", "Dear Mr. {name},", "Sincerely, {name}",
    "Best regards, {name}", "Signed by {name} on behalf of the firm.", "The patient, Mrs. {name}, arrived on Monday.", "Dr. {name} will see you now.",
    "Her social security number is {id}.", "SSN: {id}", "Passport number {id} was issued in May.", "Passport: {id}", "IBAN: {id}", "Transfer it to IBAN {id}, please.",
    "His ID card number is {id}.", "My credit card is {card}.", "Card number: {card}", "Charge card {card} today.", "The host has address {ip} now.",
    "Login from {ip} failed.", "IP: {ip}", "Client {ip} connected.", "I am {name}, my phone number is {phone}.", "This is {name}, call back: {phone}.",
    "Mein Name ist {name} und ich wohne in der {address}.", "Meine Telefonnummer ist {phone}.", "Telefon: {phone}", "Rufen Sie {name} an: {phone}.",
    "Sehr geehrter Herr {name},", "Sehr geehrte Frau {name},", "Mit freundlichen Grüßen, {name}", "Schreiben Sie an {email}.", "Adresse: {address}", "Ausweisnummer: {id}",
    "Je m'appelle {name} et j'habite {address}.", "Mon numéro de téléphone est le {phone}.", "Tél. : {phone}", "Appelez {name} au {phone}.", "Madame {name},",
    "Monsieur {name},", "Écrivez à {email} avant lundi.", "Adresse : {address}", "Courriel : {email}", "Numéro de passeport : {id}",
    "Me llamo {name} y vivo en {address}.", "Mi número de teléfono es {phone}.", "Teléfono: {phone}", "Llame a {name} al {phone}.", "Estimado señor {name}:",
    "Estimada señora {name}:", "Escriba a {email} hoy.", "Dirección: {address}", "Correo: {email}", "DNI: {id}", "Mi nombre es {name}.",
    "Atentamente, {name}", "My email address is {email}.", "My address is {address}.", "Mi correo es {email}.", "Mon adresse est {address}.", "Meine Adresse lautet {address}.",
)

#: Sentences without personal data, near in form to those with it.
PLAIN = (
    "Order 4711 was shipped on 2024-03-05 and cost 19.99 in all.", "Version 2.14.3 came out in March 2021.", "See chapter 12, page 345, table 6.", "Meet at 10:30 or 14:45 in room 212.",
    "The score was 3-2 after 90 minutes.", "In 1998-1999 about 1,250,000 units were sold.", "It was 25.4 mm wide and 100 mm long.", "Part no. 55-0199-212 fits model X200.",
    "The Main Street of the town was empty.", "Look at the dot at the end of the line.", "He arrived at noon at the station.", "The point at which the lines meet is a dot.",
    "New York and Los Angeles are large cities.", "The United Nations met in Geneva on Monday.", "Dear all, the meeting is moved.", "Dear customer, your order is ready.",
    "Name: unknown", "Phone: none", "The phone number is missing.", "Call the office for help.", "Please contact us by email.", "The name of the river is long.",
    "Der Name der Rose ist ein Roman.", "Die Telefonnummer fehlt.", "Am 5. Mai 2020 um 12 Uhr begann das Fest.", "Die Straße ist 15 km lang.", "Er wohnt in der Stadt.",
    "Le 14 juillet 1789 est une date connue.", "La rue est longue de 75 m.", "Le numéro 12 est sorti lundi.", "L'adresse manque.", "Appelez le bureau.",
    "El 8 de mayo de 2013 fue un día de sol.", "La calle mayor es larga.", "El número 28 salió hoy.", "Llame a la oficina.", "Falta la dirección.",
    "Das Haus steht am Ufer und der Garten ist groß.", "Die Katze schläft, der Hund bellt.", "Das Buch liegt auf dem Tisch im Zimmer.", "Am Freitag hat die Regierung ein Gesetz beschlossen.",
    "Der Zug nach Hamburg fährt am Abend.", "Die Kinder spielen im Park, weil das Wasser warm ist.", "In Berlin wurde der Preis am Sonntag vergeben.", "Please write soon and send more.",
    "The Bank of England raised rates in June.", "At the hotel she ordered tea, then went out at night.", "La Banque de France a publié un rapport en mai.", "El Banco de España bajó los tipos en junio.",
    "x = 12 + 30 * (4 - 555) / 2", "for i in range(100): a[i] = 0", "return at [0] or dot [1]", "0x1F3A and 0b1011 are numbers.", "Error 404 at line 1123.", "ISO 9001:2015 and RFC 2616 apply.",
    "12:30:45 INFO started worker 7", "GET /index 200 1532", "1 2 3 4 5 6 7 8 9 10", "a 12 b 34 c 56", "Total: 1.234,56", "10.5 20.5 30.5 40.5", "100 200 300 400 500",
    "Win 1000000 now!!! Call today!!!", "token = abc123def456", "The IBAN is missing.", "Passport control is closed.", "Card games are fun.", "std::vector and a::b::c are names.",
    "Chapter One The Old House", "Table Of Contents Preface", "Copyright 2020 Example Press", "Sincerely hoping for rain, they waited.", "Best regards to all.",
)

ROUNDS = 6
_SLOT = re.compile(r"\{(\w+)\}")


def labelled_rows() -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, spans): every sentence in ROUNDS fillings, slots filled in turn; plain sentences twice."""
    turn = dict.fromkeys(FILLERS, 0)
    rows = []
    for _ in range(ROUNDS):
        for sentence in SENTENCES:
            out, spans, at = "", [], 0
            for m in _SLOT.finditer(sentence):
                kind = m[1]
                filler = FILLERS[kind][turn[kind] % len(FILLERS[kind])]
                turn[kind] += 1
                out += sentence[at : m.start()]
                spans.append((kind, len(out), len(out) + len(filler)))
                out += filler
                at = m.end()
            rows.append((out + sentence[at:], spans))
    return rows + [(text, []) for text in PLAIN] * 2


def cue_words() -> list[str]:
    """The words around the slots and of plain sentences, lower-cased."""
    words = set()
    for sentence in SENTENCES + PLAIN:
        words |= {w.lower() for w in re.findall(r"[^\W\d_]+", _SLOT.sub(" ", sentence))}
    return sorted(words)
