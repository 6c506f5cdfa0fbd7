"""The small labelled table of the field: sentences written and labelled by hand, {kind:span} around personal data."""

from __future__ import annotations

import re

#: Labelled sentences; what is not in braces is not personal data.
SENTENCES = """
Call me at {phone:(555) 123-4567} after six.
My number is {phone:555-867-5309}, ask for Jenny.
Phone {phone:(020) 7946 0958} or write to {email:info@example.org}.
Tel. {phone:030/901820} (office hours only)
Tel {phone:0171 2345678} is answered by the night porter.
Reach the desk on {phone:+44 20 7946 0018}.
Fax: {phone:212.555.0147}
For bookings ring {phone:01632 960 983} before noon.
Mobile {phone:07700 900 461}, home {phone:01632 960 512}
Please dial {phone:1-800-555-0199} to reach an agent.
The hotline {phone:0800 111 2233} is free of charge.
Sie erreichen uns unter {phone:(0221) 4710-123} oder {phone:0221 4710-124}.
Rufen Sie {phone:089 / 636-48018} an.
Appelez le {phone:01 40 20 50 50} pour un rendez-vous.
Mon portable: {phone:06 12 34 56 78}.
Llame al {phone:91 573 98 26} o al {phone:(91) 573-9827}.
El fax es {phone:932-174-550} y no cambia.
Contact {phone:+1 (303) 555-0123} in an emergency.
Her cell, {phone:404.555.0162}, was off.
his phone is {phone:(718)555-0113}
Customer line {phone:555 010 4477} closes at 9.
You can text {phone:(646) 555-0139}!!
SMS an {phone:0160 5551234} genügt
Write to {email:jane.doe@mail.example.com} today.
Send mail to {email:bob_smith99@example.net}.
{email:admin@localhost} got the alert.
E-mail: {email:sales+eu@shop.example.de}, web: www.example.de
Please copy {email:root@server7} on this.
contact {email:maria-lopez@correo.example.es} para más datos
Schreiben Sie an {email:kundendienst@firma.example}.
Écrivez à {email:jean.dupont@courrier.example.fr} avant lundi
<{email:li.wei@example.cn}> wrote:
from {email:operator@intranet} to {email:audit@intranet}
The host {ip:192.168.10.24} did not answer.
Ping {ip:10.0.0.138} first, then {ip:10.0.0.139}.
Server at {ip:172.16.254.1}, port 8080
Blocked {ip:203.0.113.77} after 5 attempts.
Zugriff von {ip:198.51.100.23} um 14:05
depuis l'adresse {ip:192.0.2.146} hier
IP: {ip:8.8.4.4}
la dirección {ip:100.64.12.9} está libre
Card {card:4111 1111 1111 1111} expires 09/27.
Pay with {card:5500-0000-0000-0004} please.
Amex {card:3782 822463 10005} was declined.
account {card:378282246310005} charged twice
Visa {card:4012888888881881}, cvv 123
The old card {card:4222222222222} has 13 digits.
Kreditkarte {card:6011 1111 1111 1117} gesperrt
carte {card:3056 930902 5904} refusée
tarjeta {card:5105 1051 0510 5100} vencida
Diners {card:30569309025904} is accepted.
mastercard {card:5555 5555 5555 4444}!!
In 1984 he wrote 328 pages.
Version 2.0.1 was released on 2019-05-14.
The price rose from $12.50 to $13.75, or 10%.
See section 4.2.1 and figure 3.
ISBN 978-3-16-148410-0 is out of print.
ISBN-10: 0-306-40615-2
Order no. 1029384756 shipped on 03.04.2021.
Invoice 2020-118273 of 14/02/2020 is due.
Meet at 14:30 in room 207.
The population was 1,234,567 in 2001.
He ran 42.195 km in 2:03:59.
token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
commit 1a2b3c4d5e6f fixed 17 bugs
Thanks @maria and @the_real_tom for the help
install @scope/package@1.2.3 with npm
Die Auflage 1998 hat 512 Seiten.
Am 24.12.2005 lagen 30 cm Schnee.
Le 14 juillet 1789, environ 900 personnes
El 12 de octubre de 1492 llegaron 3 barcos.
Chapter 12 covers 1939-1945.
Licensed under CC BY-NC 4.0.
GNU General Public License, version 3.
Pi is about 3.14159265358979.
Coordinates 48.8584, 2.2945 mark the tower.
Flight LH 2030 leaves gate B27 at 6:45.
Part number AX-4471-0092 is sold out.
build 10.0.19045.3803 of windows
firmware 1.14.2.3 fixes it, 1.14.2.4 will not
Room 101, floor 3, desk 12
Tracking code 1Z999AA10123456784 is valid.
The serial 4929-1834-22 is printed below.
mp3 at 320 kbps, 44.1 kHz, 16 bit
The years 1914, 1939 and 1989 matter.
a@b is no address in this formula x@y
Total: 1 234 567,89 EUR
Kontonummer 0532013000, BLZ 37040044
Timestamp 1609459200 equals 2021-01-01.
UTC+02:00 since 28.03.
ratio 16:9, 1920x1080 pixels
scores were 21-19, 18-21 and 21-17
The id 550e8400-e29b-41d4-a716-446655440000 is unique.
Read pages 100-120, 200-215 of vol. 7.
8 of 10 cats prefer 2 meals
route 66 is 3940 km long
"""

_MARK = re.compile(r"\{(\w+):([^}]*)\}")


def labelled_table() -> list[tuple[list[str], list[str]]]:
    """(words, labels) of each sentence; a word of a span is labelled B-kind or I-kind, any other O."""
    out = []
    for line in SENTENCES.strip().split("\n"):
        words: list[str] = []
        labels: list[str] = []
        at, text, spans = 0, "", []
        for m in _MARK.finditer(line):
            text += line[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), m[1]))
            text += m[2]
            at = m.end()
        text += line[at:]
        last = None
        for m in re.finditer(r"\S+", text):
            own = next((s for s in spans if s[0] < m.end() and m.start() < s[1]), None)
            words.append(m[0])
            labels.append("O" if own is None else f"{'I' if own is last else 'B'}-{own[2]}")
            last = own
        out.append((words, labels))
    return out
