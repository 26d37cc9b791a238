"""Industrial protocol messages to typed events, as column expressions over the payload.

Each decoder takes messages ``(ts_us, seq, src_ip, dst_ip, src_port, dst_port,
payload)`` and keeps those of its protocol. Names, operation types and risks come
from literal maps. ``details`` is filled with what was asked of which target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace import dims
from fieldtrace.functions.bytesx import bits, nbytes, rest, take, u8, u16, u16le, u32le
from fieldtrace.functions.text import shannon_entropy
from fieldtrace.operators.events import threat_score
from fieldtrace.operators.sliced import running
from fieldtrace.session import stage

EVENT_COLUMNS = ["ts_us", "seq", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "function_code", "function_name",
                 "operation_type", "risk_level", "unit_id", "data_address", "data_count", "raw", "notes", "mitre", "threat_score",
                 "payload_entropy", "payload_byte", "details"]


def _of(table: dict, code: Column, index: int, default: Column) -> Column:
    return dims.lookup(table, code, lambda v: v[index], default)


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value.cast("long")), digits, "0")


def _unknown(code: Column) -> Column:
    return F.concat(F.lit("Unknown ("), code.cast("string"), F.lit(")"))


def details(op, target=None, value=None, is_request=None, count=None, station=None, extra: dict | None = None) -> Column:
    def col(x, kind):
        return (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    pairs = [y for k, v in (extra or {}).items() for y in (F.lit(k), col(v, "string"))]
    more = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(col(op, "string").alias("op"), col(target, "string").alias("target"), col(value, "double").alias("value"),
                    col(is_request, "boolean").alias("is_request"), col(count, "int").alias("count"), col(station, "string").alias("station"),
                    F.lit(False).alias("cyclic"), more.alias("extra"))


def _event(rows: DataFrame, protocol: str, code, name, op_type, risk, *, unit=None, address=None, count=None, notes=None, mitre=None,
           score=None, entropy_from=0, change_at=0, detail=None) -> DataFrame:
    """Project decoded columns to the event schema."""
    P = F.col("payload")
    none = F.array().cast("array<string>")
    entropy = shannon_entropy(rest(P, entropy_from)) if entropy_from is not None else F.lit(0.0)
    rows = (rows.withColumn("risk_level", risk).withColumn("payload_entropy", entropy))
    base = score if score is not None else threat_score(F.col("risk_level"))
    return rows.select(
        "ts_us", "seq", "src_ip", "dst_ip", "src_port", "dst_port", F.lit(protocol).alias("protocol"), code.cast("int").alias("function_code"),
        name.alias("function_name"), op_type.alias("operation_type"), "risk_level",
        (unit if unit is not None else F.lit(0)).cast("int").alias("unit_id"), (address if address is not None else F.lit(0)).cast("int").alias("data_address"),
        (count if count is not None else F.lit(0)).cast("int").alias("data_count"), P.alias("raw"),
        (notes if notes is not None else F.lit("")).alias("notes"), (F.array_distinct(mitre) if mitre is not None else none).alias("mitre"),
        F.least(F.lit(1.0), base).cast("double").alias("threat_score"), "payload_entropy", u8(P, change_at).alias("payload_byte"),
        (detail if detail is not None else details(None)).alias("details"))


def _add(base: Column, test: Column, *more: str) -> Column:
    return F.when(test, F.concat(base, F.array(*[F.lit(m) for m in more]))).otherwise(base)


# --------------------------------------------------------------------------- Modbus

def decode_modbus(pdus: DataFrame) -> DataFrame:
    P = F.col("payload")
    rows = pdus.where((nbytes(P) >= 8) & (u16(P, 2) == 0) & u16(P, 4).between(2, 256))
    fc, unit = u8(P, 7), u8(P, 6)
    size = nbytes(P)
    rows = rows.withColumn("_fc", fc).withColumn("_unit", unit).withColumn(
        "_reply", (F.col("src_port") == 502) & (F.col("dst_port") != 502)).withColumn("_error", fc >= 0x80)
    fc, unit = F.col("_fc"), F.col("_unit")
    asked = ~F.col("_error") & ~F.col("_reply")
    simple = asked & fc.isin(1, 2, 3, 4, 5, 6) & (size >= 12)
    multi = asked & fc.isin(15, 16) & (size >= 13)
    both = asked & (fc == 23) & (size >= 17)
    address = F.when(simple | multi, u16(P, 8)).when(both, u16(P, 12)).otherwise(0)
    count = F.when(simple & fc.isin(1, 2, 3, 4), u16(P, 10)).when(multi, u16(P, 10)).when(both, u16(P, 14)).otherwise(0)
    rows = rows.withColumn("_addr", address).withColumn("_n", count)
    address, count = F.col("_addr"), F.col("_n")
    full = multi & (fc == 16) & (size >= u8(P, 12) + 13)
    written = F.when(simple & fc.isin(5, 6), u16(P, 10)).when(full & (count > 0), u16(P, 13))
    values = F.when(simple & fc.isin(5, 6), F.array(u16(P, 10))).when(full & (count > 0), F.filter(F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: u16(P, i * 2 + 13)), lambda v: v.isNotNull())).otherwise(F.array().cast("array<int>"))
    original = F.when(F.col("_error"), fc - 0x80).otherwise(fc)
    exception = dims.lookup(dims.MODBUS_EXCEPTIONS, F.coalesce(u8(P, 8), F.lit(0)), lambda v: v, F.concat(F.lit("UNKNOWN_"), F.coalesce(u8(P, 8), F.lit(0)).cast("string")))
    base = _of(dims.MODBUS_FUNCTIONS, fc, 0, _unknown(fc))
    name = (F.when(F.col("_error"), F.concat(F.lit("Exception (FC="), original.cast("string"), F.lit(", "), exception, F.lit(")")))
            .when(F.col("_reply"), F.concat(base, F.lit(" (Response)"))).otherwise(base))
    op_type = F.when(F.col("_error"), "ERROR").when(F.col("_reply"), "RESPONSE").otherwise(_of(dims.MODBUS_FUNCTIONS, fc, 1, F.lit("UNKNOWN")))
    rows = rows.withColumn("_op", op_type)
    op_type = F.col("_op")
    much = simple & ((fc.isin(1, 2) & (count > 2000)) | (fc.isin(3, 4) & (count > 125)))
    too_many = multi & (((fc == 15) & (count > 1968)) | ((fc == 16) & (count > 123)))
    broadcast = unit.isin(0, 255)
    region = F.coalesce(*[F.when(address.between(lo, hi), F.lit(label)) for lo, hi, label in dims.MODBUS_RANGES])
    critical = (asked & fc.isin(65, 66, 90)) | too_many | (broadcast & op_type.isin("WRITE", "CONTROL")) | ((op_type == "WRITE") & region.isNotNull())
    risk = (F.when(critical, "CRITICAL").when(F.col("_error"), "MEDIUM").when(F.col("_reply"), "LOW").when(much, "HIGH")
            .otherwise(_of(dims.MODBUS_FUNCTIONS, fc, 2, F.lit("MEDIUM"))))
    none = F.array().cast("array<string>")
    scan = F.col("_error") & (u8(P, 8) == 1)
    mitre = F.when(scan, F.array(F.lit("T0841"), F.lit("T0808"))).when(F.col("_error"), dims.techniques(dims.MODBUS_FUNCTIONS, fc)).when(
        F.col("_reply"), none).otherwise(dims.techniques(dims.MODBUS_FUNCTIONS, fc))
    mitre = _add(mitre, too_many & (fc == 15), "T0806")
    mitre = _add(mitre, asked & fc.isin(65, 66, 90), "T0816", "T0815")
    mitre = _add(mitre, broadcast & op_type.isin("WRITE", "CONTROL"), "T0806")
    score = (threat_score(F.col("risk_level")) + F.when(F.col("payload_entropy") > 7.5, 0.2).otherwise(0.0) + F.when(count > 100, 0.1).otherwise(0.0)
             + F.when(F.exists(values, lambda v: v > 32767), 0.1).otherwise(0.0))
    op = (F.when(F.col("_error"), "ERROR").when(F.col("_reply"), "RESPONSE").when(fc.isin(1, 2, 3, 4), "READ").when(fc.isin(5, 6, 15, 16, 22, 23), "WRITE")
          .when(fc == 65, "RESTART").when(fc == 66, "LOG_CLEAR").when(fc == 90, "FIRMWARE_UPDATE").when(fc.isin(17, 43), "IDENTIFY").otherwise("OTHER"))
    kind = F.when(fc.isin(1, 5, 15), "coil ").when(fc == 2, "input ").otherwise("register ")
    notes = F.concat_ws(", ", F.concat(F.lit("TransID="), u16(P, 0).cast("string")), F.concat(F.lit("Len="), u16(P, 4).cast("string")),
                        F.when(broadcast, "BROADCAST"), F.when(scan, "POSSIBLE_SCAN"), F.when(much, "EXCESSIVE_READ_COUNT"),
                        F.when(too_many, "EXCESSIVE_WRITE_COUNT"), F.when(op_type == "WRITE", region))
    return _event(rows, "MODBUS_TCP", fc, name, op_type, risk, unit=unit, address=address, count=count, notes=notes, mitre=mitre, score=score,
                  entropy_from=8, change_at=10,
                  detail=details(op, F.when(asked & (simple | multi | both), F.concat(kind, address.cast("string"))), written, asked, count,
                                 F.concat(F.lit("unit "), unit.cast("string"))))


# --------------------------------------------------------------------------- S7

def decode_s7comm(pdus: DataFrame) -> DataFrame:
    P = F.col("payload")
    rows = pdus.where((nbytes(P) >= 10) & (u8(P, 0) == 3)).withColumn("_at", 5 + u8(P, 4))
    at = F.col("_at")
    rows = rows.where((nbytes(P) >= at + 10) & (u8(P, at) == 0x32)).withColumn("_type", u8(P, at + 1))
    kind = F.col("_type")
    rows = rows.withColumn("_param", at + F.when(kind.isin(2, 3), 12).otherwise(10)).where((u16(P, at + 6) > 0) & (nbytes(P) > F.col("_param")))
    user = (kind == 7) & (nbytes(P) > F.col("_param") + 5)
    group = bits(u8(P, F.col("_param") + 5), 15)
    rows = rows.withColumn("_fc", F.when(user, group + 0x100).otherwise(u8(P, F.col("_param"))))
    fc = F.col("_fc")
    wide, reply = fc >= 0x100, kind.isin(2, 3)
    grp = fc - 0x100
    base = F.when(wide, F.concat(F.lit("Userdata: "), dims.lookup(dims.S7_GROUPS, grp, lambda v: v, F.concat(F.lit("Group "), grp.cast("string"))))
                  ).otherwise(_of(dims.S7_FUNCTIONS, fc, 0, _unknown(fc)))
    op_type = F.when(reply, "RESPONSE").when(wide, "READ").otherwise(_of(dims.S7_FUNCTIONS, fc, 1, F.lit("UNKNOWN")))
    risk = (F.when(reply, "LOW").when(wide & grp.isin(1, 5), "MEDIUM").when(wide, "LOW").otherwise(_of(dims.S7_FUNCTIONS, fc, 2, F.lit("MEDIUM"))))
    mitre = F.when(wide, dims.strings()).otherwise(dims.techniques(dims.S7_FUNCTIONS, fc))
    kinds = {1: "Job", 2: "Ack", 3: "AckData", 7: "Userdata"}
    op = (F.when(reply, "RESPONSE").when(wide, "STATUS").when(fc == 4, "READ").when(fc == 5, "WRITE").when(fc.isin(0x1A, 0x1B, 0x1C), "PROGRAM_DOWNLOAD")
          .when(fc.isin(0x1D, 0x1E, 0x1F), "PROGRAM_UPLOAD").when(fc == 0x28, "PLC_START").when(fc == 0x29, "PLC_STOP").when(fc == 0xF0, "SESSION_START").otherwise("OTHER"))
    return _event(rows, "S7COMM", fc, F.when(reply, F.concat(base, F.lit(" (Response)"))).otherwise(base), op_type, risk, mitre=mitre,
                  notes=F.concat(F.lit("Type="), dims.lookup(kinds, kind, lambda v: v, F.concat(F.lit("Type "), kind.cast("string")))),
                  score=F.when(fc.between(0x1A, 0x1F), 1.0).otherwise(threat_score(F.col("risk_level"))), entropy_from=at, change_at=at + 10,
                  detail=details(op, is_request=~reply))


# --------------------------------------------------------------------------- DNP3

def decode_dnp3(pdus: DataFrame) -> DataFrame:
    P = F.col("payload")
    rows = pdus.where((nbytes(P) >= 10) & (u16(P, 0) == 0x0564))
    rows = rows.withColumn("_fc", F.when((u8(P, 2) <= 5) | (nbytes(P) < 13), 0xFF).otherwise(u8(P, 12)))
    fc = F.col("_fc")
    op = (F.when(fc == 1, "READ").when(fc == 2, "WRITE").when(fc == 3, "CONTROL_SELECT").when(fc == 4, "CONTROL_EXECUTE").when(fc.isin(5, 6), "CONTROL_DIRECT")
          .when(fc.isin(0x0D, 0x0E), "RESTART").when(fc == 0x12, "PLC_STOP").when(fc == 0x11, "PLC_START").when(fc == 0x13, "CONFIG_WRITE")
          .when(fc == 0x15, "UNSOLICITED_DISABLE").when(fc.isin(0x81, 0x82), "RESPONSE").otherwise("OTHER"))
    return _event(rows, "DNP3", fc, _of(dims.DNP3_FUNCTIONS, fc, 0, _unknown(fc)), _of(dims.DNP3_FUNCTIONS, fc, 1, F.lit("UNKNOWN")),
                  _of(dims.DNP3_FUNCTIONS, fc, 2, F.lit("MEDIUM")), mitre=dims.techniques(dims.DNP3_FUNCTIONS, fc),
                  notes=F.concat(F.lit("DNP3Dst="), u16le(P, 4).cast("string"), F.lit(", DNP3Src="), u16le(P, 6).cast("string"), F.lit(", Ctrl=0x"), _hex(u8(P, 3), 2)),
                  entropy_from=10, change_at=12, detail=details(op, station=F.concat(F.lit("station "), u16le(P, 4).cast("string")),
                                                                is_request=bits(u8(P, 3), 0x80) != 0))


# --------------------------------------------------------------------------- EtherNet/IP

def _cip_offset() -> Column:
    """Offset of the CIP service inside the data items of SendRRData/SendUnitData; an item takes four bytes at least."""
    P = F.col("payload")
    start = F.struct(F.lit(32).alias("at"), F.lit(-1).alias("found"), (u16le(P, 30)).cast("int").alias("left"))

    def item(s: Column, _: Column) -> Column:
        kind, size = u16le(P, s["at"]), u16le(P, s["at"] + 2)
        open_ = (s["found"] < 0) & (s["left"] > 0) & (nbytes(P) >= s["at"] + 4)
        found = F.when(kind == 0xB2, s["at"] + 4).when(kind == 0xB1, s["at"] + 6).otherwise(-1)
        return F.when(open_, F.struct((s["at"] + 4 + size).cast("int").alias("at"), found.cast("int").alias("found"), (s["left"] - 1).cast("int").alias("left"))).otherwise(s)
    most = F.greatest(F.least(u16le(P, 30), F.floor((nbytes(P) - 32) / 4).cast("int") + 1), F.lit(1))
    walk = F.aggregate(F.sequence(F.lit(1), most), start, item)
    return F.when(nbytes(P) >= 32, walk["found"])


def decode_enip(pdus: DataFrame) -> DataFrame:
    P = F.col("payload")
    rows = pdus.where(nbytes(P) >= 24).withColumn("_cmd", u16le(P, 0))
    cmd = F.col("_cmd")
    rows = rows.withColumn("_at", F.when(cmd.isin(0x6F, 0x70), _cip_offset()))
    inside = F.coalesce((F.col("_at") >= 0) & (F.col("_at") < nbytes(P)), F.lit(False))
    first = u8(P, F.col("_at"))
    rows = rows.withColumn("_svc", F.when(inside, bits(first, 0x7F))).withColumn("_reply", inside & (bits(first, 0x80) != 0))
    svc, reply = F.col("_svc"), F.col("_reply")
    base = _of(dims.ENIP_COMMANDS, cmd, 0, F.concat(F.lit("Unknown (0x"), _hex(cmd, 4), F.lit(")")))
    cip = _of(dims.CIP_SERVICES, svc, 0, F.concat(F.lit("CIP Service "), svc.cast("string")))
    name = F.when(svc.isNotNull(), F.concat(base, F.lit(" -> "), cip, F.when(reply, F.lit(" (Response)")).otherwise(F.lit("")))).otherwise(base)
    asked = svc.isNotNull() & ~reply
    op_type = F.when(reply, "RESPONSE").when(asked, _of(dims.CIP_SERVICES, svc, 1, F.lit("UNKNOWN"))).otherwise(_of(dims.ENIP_COMMANDS, cmd, 1, F.lit("UNKNOWN")))
    risk = F.when(reply, "LOW").when(asked, _of(dims.CIP_SERVICES, svc, 2, F.lit("MEDIUM"))).otherwise(_of(dims.ENIP_COMMANDS, cmd, 2, F.lit("MEDIUM")))
    mitre = F.concat(dims.techniques(dims.ENIP_COMMANDS, cmd),
                     F.when(asked, dims.techniques(dims.CIP_SERVICES, svc)).otherwise(dims.strings()))
    op = (F.when(reply, "RESPONSE").when(svc.isin(0x4D, 0x4F, 0x52, 0x10, 0x02, 0x04), "WRITE").when(svc.isin(0x4C, 0x4E, 0x01, 0x03, 0x0E), "READ")
          .when(svc == 0x05, "RESTART").when(svc == 0x06, "PLC_START").when(svc == 0x07, "PLC_STOP").when(cmd.isin(1, 4, 0x63), "IDENTIFY")
          .when(cmd == 0x65, "SESSION_START").when(cmd == 0x66, "SESSION_STOP").otherwise("OTHER"))
    return _event(rows, "ENIP", cmd, name, op_type, risk, mitre=mitre,
                  notes=F.concat(F.lit("Session=0x"), _hex(u32le(P, 4), 8), F.lit(", Status=0x"), _hex(u32le(P, 8), 8), F.lit(", CIP=0x"), _hex(F.coalesce(svc, F.lit(0)), 2)),
                  entropy_from=24, change_at=24, detail=details(op, is_request=F.when(svc.isNotNull(), asked)))


# --------------------------------------------------------------------------- IEC 104

def decode_iec104(pdus: DataFrame) -> DataFrame:
    P = F.col("payload")
    rows = pdus.where((nbytes(P) >= 6) & (u8(P, 0) == 0x68) & (nbytes(P) >= u8(P, 1) + 2)).withColumn("_c", u8(P, 2))
    c = F.col("_c")
    frame = F.when(bits(c, 1) == 0, "I").when(bits(c, 3) == 1, "S").when(bits(c, 3) == 3, "U")
    rows = rows.withColumn("_f", frame).where((F.col("_f") != "I") | (nbytes(P) >= 12)).withColumn("_t", u8(P, 6))
    i, s, u, t = F.col("_f") == "I", F.col("_f") == "S", F.col("_f") == "U", F.col("_t")
    code = F.when(i, t).when(s, 0xFE).otherwise(c)
    named = _of(dims.IEC104_TYPES, t, 0, F.concat(F.lit("Type_"), t.cast("string"), F.lit(" - Unknown ASDU Type "), t.cast("string")))
    name = F.when(i, named).when(s, "S-Format (Supervisory)").otherwise(dims.lookup(dims.IEC104_U, c, lambda v: v[0], F.concat(
        F.lit("U-Format 0x"), _hex(c, 2), F.lit(" - Unknown U-format"))))
    kind = _of(dims.IEC104_TYPES, t, 1, F.lit("UNKNOWN"))
    op_type = F.when(i, kind).when(s, "ACK").otherwise("CONTROL")
    risk = (F.when(i & (kind == "CONTROL"), "HIGH").when(i, _of(dims.IEC104_TYPES, t, 2, F.lit("MEDIUM"))).when(s, "LOW")
            .otherwise(dims.lookup(dims.IEC104_U, c, lambda v: v[1], F.lit("MEDIUM"))))
    stop = u & c.isin(0x13, 0x23)
    none = F.array().cast("array<string>")
    mitre = (F.when(i & (kind == "CONTROL"), F.array(F.lit("T0831"), F.lit("T0835"))).when(i & (kind == "READ"), F.array(F.lit("T0801"), F.lit("T0802")))
             .when(stop, F.array(F.lit("T0813"), F.lit("T0814"))).otherwise(none))
    score = F.when(i & (kind == "CONTROL"), 0.5).when(i, 0.2).when(s, 0.1).when(stop, 0.6).otherwise(0.3)
    ioa = u8(P, 12) + u8(P, 13) * 256 + u8(P, 14) * 65536
    commanded = F.when(t.isin(45, 46, 47), bits(u8(P, 15), 3)).when(t == 50, F.when(u16le(P, 15) > 32767, u16le(P, 15) - 65536).otherwise(u16le(P, 15)))
    selects = bits(u8(P, 15), 0x80) != 0
    op = (F.when(i & t.isin(48, 50), "SETPOINT").when(i & (kind == "CONTROL") & (t == 105), "RESTART").when(i & (kind == "CONTROL") & F.coalesce(selects, F.lit(False)), "CONTROL_SELECT")
          .when(i & (kind == "CONTROL"), "CONTROL_EXECUTE").when(i & t.isin(100, 101), "INTERROGATION").when(i & (t == 103), "CLOCK_SET").when(i & (kind == "READ"), "STATUS")
          .when(u & c.isin(0x07, 0x0B), "SESSION_START").when(stop, "TRANSMISSION_OFF").when(s | u, "KEEPALIVE").otherwise("OTHER"))
    notes = (F.when(i, F.concat(F.lit("I-Frame, COT="), u8(P, 8).cast("string"), F.lit(", VSQ="), u8(P, 7).cast("string")))
             .when(s, F.concat(F.lit("S-Frame, RecvSeq="), F.shiftright(u16le(P, 4), 1).cast("string"))).otherwise("U-Frame"))
    out = _event(rows, "IEC_104", code, name, op_type, risk, mitre=mitre, score=score, notes=notes, entropy_from=6, change_at=9,
                 detail=details(op, F.when(i & ioa.isNotNull(), F.concat(F.lit("CA="), u16le(P, 10).cast("string"), F.lit(" IOA="), ioa.cast("string"))),
                                F.when(i & (kind == "CONTROL"), commanded), F.col("dst_port") == 2404, station=F.when(i, F.concat(F.lit("CA "), u16le(P, 10).cast("string")))))
    return out.withColumn("payload_entropy", F.when(F.col("notes").startswith("I-Frame"), F.col("payload_entropy")).otherwise(0.0))


# --------------------------------------------------------------------------- BACnet

def decode_bacnet(pdus: DataFrame) -> DataFrame:
    P = F.col("payload")
    rows = pdus.where((nbytes(P) >= 4) & (u8(P, 0) == 0x81)).withColumn("_b", u8(P, 1))
    b = F.col("_b")
    control = u8(P, 5)
    routed = b.isin(4, 10, 11) & (nbytes(P) > 6)
    dest, source = bits(control, 0x20) != 0, bits(control, 0x08) != 0
    rows = rows.withColumn("_a1", F.lit(6) + F.when(dest, 3 + F.coalesce(u8(P, 8), F.lit(0))).otherwise(0))
    rows = rows.withColumn("_a2", F.col("_a1") + F.when(source, 3 + F.coalesce(u8(P, F.col("_a1") + 2), F.lit(0))).otherwise(0))
    rows = rows.withColumn("_at", F.when(routed, F.col("_a2") + F.when(dest, 1).otherwise(0)))
    at = F.col("_at")
    rows = rows.withColumn("_apdu", F.when(at < nbytes(P), F.shiftright(u8(P, at), 4)))
    apdu = F.col("_apdu")
    confirmed = (apdu == 0) & (at + 3 < nbytes(P))
    unconfirmed = (apdu == 1) & (at + 1 < nbytes(P))
    where = F.when(bits(u8(P, at), 8) != 0, at + 5).otherwise(at + 3)
    rows = rows.withColumn("_svc", F.when(confirmed, F.coalesce(u8(P, where), F.lit(0))).when(unconfirmed, u8(P, at + 1))).withColumn("_kind", F.when(
        confirmed, "C").when(unconfirmed, "U").otherwise("B"))
    svc, kind = F.col("_svc"), F.col("_kind")
    bvlc = _of(dims.BVLC_FUNCTIONS, b, 0, F.concat(F.lit("Unknown BVLC (0x"), _hex(b, 2), F.lit(")")))
    service = F.when(kind == "C", _of(dims.BACNET_CONFIRMED, svc, 0, F.concat(F.lit("ConfirmedService_"), svc.cast("string")))).otherwise(
        _of(dims.BACNET_UNCONFIRMED, svc, 0, F.concat(F.lit("UnconfirmedService_"), svc.cast("string"))))

    def pick(index, bdef, cdef, udef):
        return (F.when(kind == "C", _of(dims.BACNET_CONFIRMED, svc, index, F.lit(cdef))).when(kind == "U", _of(dims.BACNET_UNCONFIRMED, svc, index, F.lit(udef)))
                .otherwise(_of(dims.BVLC_FUNCTIONS, b, index, F.lit(bdef))))
    name = F.when(kind == "B", bvlc).otherwise(F.concat(bvlc, F.lit(" -> "), service))
    choice = F.coalesce(svc, F.lit(0))
    score = threat_score(F.col("risk_level")) + F.when(choice.isin(15, 16, 17, 20), 0.3).otherwise(0.0)
    c = kind == "C"
    op = (F.when(c & svc.isin(15, 16), "WRITE").when(c & svc.isin(12, 13, 14), "READ").when(c & (svc == 20), "RESTART").when(c & (svc == 7), "FILE_WRITE").when(
        c & (svc == 6), "FILE_READ").when((kind == "U") & svc.isin(0, 7, 8), "IDENTIFY").when((kind == "U") & svc.isin(6, 9), "CLOCK_SET").otherwise("OTHER"))
    return _event(rows, "BACNET", F.when(choice != 0, choice).otherwise(b), name, pick(1, "UNKNOWN", "UNKNOWN", "UNKNOWN"), pick(2, "MEDIUM", "MEDIUM", "LOW"),
                  mitre=F.when(kind == "C", dims.techniques(dims.BACNET_CONFIRMED, svc)).when(kind == "U", dims.techniques(dims.BACNET_UNCONFIRMED, svc))
                  .otherwise(dims.techniques(dims.BVLC_FUNCTIONS, b)), score=score, entropy_from=4, change_at=4,
                  notes=F.concat(F.lit("BVLC=0x"), _hex(b, 2), F.lit(", APDU_Type="), F.coalesce(apdu, F.lit(0)).cast("string"), F.lit(", Service="), choice.cast("string")),
                  detail=details(op, is_request=kind != "B"))


# --------------------------------------------------------------------------- MQTT

def _text(data: Column) -> Column:
    return F.decode(data, "UTF-8")


def decode_mqtt(pdus: DataFrame) -> DataFrame:
    P = F.col("payload")
    rows = pdus.where(nbytes(P) >= 2).withColumn("_t", F.shiftright(u8(P, 0), 4))
    lens = [u8(P, i) for i in range(1, 5)]
    width = (F.when((lens[0] < 128) | (nbytes(P) == 2), 1).when((lens[1] < 128) | (nbytes(P) == 3), 2).when((lens[2] < 128) | (nbytes(P) == 4), 3).otherwise(4))
    rows = rows.withColumn("_w", width)
    w, t = F.col("_w"), F.col("_t")
    left = F.lit(0)
    for i, byte in enumerate(lens):
        left = left + F.when(w > i, bits(byte, 0x7F) * (128 ** i)).otherwise(0)
    rows = rows.withColumn("_left", left).withColumn("_v", rest(P, w + 1))
    v = F.col("_v")
    proto = u16(v, 0)
    connect = (t == 1) & (nbytes(P) > w + 11) & (proto + 6 < nbytes(v))
    flags = u8(v, proto + 3)
    user, secret = bits(flags, 0x80) != 0, bits(flags, 0x40) != 0
    client_size = u16(v, proto + 6)
    client = F.when(connect & (proto + 8 + client_size <= nbytes(v)), _text(take(v, proto + 8, client_size))).otherwise("")
    publish = (t == 3) & (nbytes(P) > w + 3) & (u16(v, 0) > 0) & (u16(v, 0) + 2 <= nbytes(v))
    topic = F.when(publish, _text(take(v, 2, u16(v, 0))))
    rows = rows.withColumn("_topic", topic).withColumn("_open", F.coalesce(connect & ~user & ~secret, F.lit(False)))
    subscribe = (t == 8) & (nbytes(P) > w + 5)
    begin = F.struct(F.lit(2).alias("at"), F.array().cast("array<string>").alias("topics"), F.lit(False).alias("done"))

    def one(s: Column, _: Column) -> Column:
        size = u16(v, s["at"])
        good = ~s["done"] & (s["at"] + 2 < nbytes(v)) & (s["at"] + 2 + size + 1 <= nbytes(v))
        return F.when(F.coalesce(good, F.lit(False)), F.struct((s["at"] + 3 + size).cast("int").alias("at"), F.concat(s["topics"], F.array(_text(take(v, s["at"] + 2, size)))).alias("topics"),
                               F.lit(False).alias("done"))).otherwise(F.struct(s["at"].alias("at"), s["topics"].alias("topics"), F.lit(True).alias("done")))
    steps = F.sequence(F.lit(1), F.greatest((nbytes(v) / 3).cast("int"), F.lit(1)))
    rows = rows.withColumn("_subs", F.when(subscribe, F.aggregate(steps, begin, one, lambda s: s["topics"])).otherwise(F.array().cast("array<string>")))
    topic, low = F.col("_topic"), F.lower(F.col("_topic"))
    topic_risk = F.coalesce(*[F.when(low.contains(p), F.lit(r)) for p, r in dims.MQTT_TOPICS])
    wide = F.exists("_subs", lambda x: (x == "#") | (x == "+") | x.startswith("$"))
    risk = F.when(F.col("_open"), "HIGH").when(topic_risk.isNotNull(), topic_risk).when(wide, "HIGH").otherwise(_of(dims.MQTT_TYPES, t, 2, F.lit("MEDIUM")))
    mitre = dims.techniques(dims.MQTT_TYPES, t)
    mitre = _add(_add(_add(mitre, F.col("_open"), "T0812"), topic_risk.isNotNull(), "T0831", "T0836"), wide, "T0802")
    notes = F.concat_ws(", ", F.concat(F.lit("Flags=0x"), F.hex(bits(u8(P, 0), 15).cast("long"))), F.concat(F.lit("Len="), F.col("_left").cast("string")),
                        F.when(connect, F.concat(F.lit("ClientID="), client, F.lit(", Auth="), F.when(user, "Yes").otherwise("No"))),
                        F.when(topic.isNotNull(), F.concat(F.lit("Topic="), topic)), F.when(topic.isNotNull() & (bits(u8(P, 0), 1) != 0), "RETAIN"),
                        F.when(F.size("_subs") > 0, F.concat(F.lit("Topics="), F.array_join("_subs", ","))))
    op = (F.when(t == 3, "PUBLISH").when(t == 1, "SESSION_START").when(t == 14, "SESSION_STOP").when(t.isin(12, 13), "KEEPALIVE").when(t == 8, "CONFIG_WRITE").otherwise("OTHER"))
    return _event(rows, "MQTT", t, _of(dims.MQTT_TYPES, t, 0, _unknown(t)), _of(dims.MQTT_TYPES, t, 1, F.lit("UNKNOWN")), risk, mitre=mitre, notes=notes,
                  entropy_from=w + 1, change_at=w + 1, detail=details(op, F.coalesce(topic, F.when(F.size("_subs") > 0, F.element_at("_subs", 1))),
                                                                      is_request=F.col("dst_port") == 1883))


# --------------------------------------------------------------------------- OPC UA

def decode_opcua(pdus: DataFrame) -> DataFrame:
    P = F.col("payload")
    rows = pdus.where(nbytes(P) >= 8).withColumn("_m", F.decode(take(P, 0, 3), "ISO-8859-1"))
    m = F.col("_m")
    service = (m == "MSG") & (nbytes(P) > 28)
    rows = rows.withColumn("_svc", F.when(service & (u8(P, 24) == 1), u16le(P, 26)).when(service & (u8(P, 24) == 0), u8(P, 25)).when(service, 0))
    svc = F.col("_svc")
    policy_size = u32le(P, 12)
    policy = F.when((m == "OPN") & (nbytes(P) > 16) & (policy_size > 0) & (nbytes(P) >= policy_size + 16), _text(take(P, 16, policy_size)))
    rows = rows.withColumn("_policy", policy)
    policy = F.col("_policy")
    naked = F.coalesce(policy.contains("None"), F.lit(False))
    url_size = u32le(P, 28)
    endpoint = F.when((m == "HEL") & (nbytes(P) > 32) & (url_size > 0) & (nbytes(P) >= url_size + 32), _text(take(P, 32, url_size)))
    base = _of(dims.OPCUA_MESSAGES, m, 0, F.concat(F.lit("Unknown ("), m, F.lit(")")))
    named = _of(dims.OPCUA_SERVICES, svc, 0, F.concat(F.lit("Service_"), svc.cast("string")))
    inside = svc.isNotNull()
    op_type = F.when(inside, _of(dims.OPCUA_SERVICES, svc, 1, F.lit("UNKNOWN"))).otherwise(_of(dims.OPCUA_MESSAGES, m, 1, F.lit("UNKNOWN")))
    risk = F.when(naked, "HIGH").when(inside, _of(dims.OPCUA_SERVICES, svc, 2, F.lit("MEDIUM"))).otherwise(_of(dims.OPCUA_MESSAGES, m, 2, F.lit("MEDIUM")))
    mitre = F.concat(dims.techniques(dims.OPCUA_MESSAGES, m), F.when(inside, dims.techniques(dims.OPCUA_SERVICES, svc)).otherwise(dims.strings()))
    mitre = _add(mitre, naked, "T0812")
    notes = F.concat_ws(", ", F.concat(F.lit("MsgType="), m), F.concat(F.lit("Size="), u32le(P, 4).cast("string")),
                        F.when(endpoint.isNotNull(), F.concat(F.lit("Endpoint="), endpoint)),
                        F.when(policy.isNotNull(), F.concat(F.lit("SecurityPolicy="), F.when(policy.contains("#"), F.substring_index(policy, "#", -1)).otherwise("Unknown"))),
                        F.when(inside, F.concat(F.lit("ServiceId="), svc.cast("string"), F.lit(", SecureChannel="), u32le(P, 8).cast("string"))))
    op = (F.when(svc == 673, "WRITE").when(svc.isin(631, 664), "READ").when(svc.isin(527, 533), "BROWSE").when(svc == 712, "CONTROL_EXECUTE")
          .when(svc.isin(422, 428), "IDENTIFY").when(svc.isin(461, 467) | m.isin("HEL", "OPN"), "SESSION_START").when((svc == 473) | (m == "CLO"), "SESSION_STOP")
          .when(named.endswith("Response"), "RESPONSE").when(m == "ERR", "ERROR").otherwise("OTHER"))
    return _event(rows, "OPC_UA", F.coalesce(svc, F.lit(0)), F.when(inside, F.concat(F.lit("MSG -> "), named)).otherwise(base), op_type, risk, mitre=mitre, notes=notes,
                  entropy_from=8, change_at=8, detail=details(op, endpoint, is_request=F.col("dst_port") == 4840))


# --------------------------------------------------------------------------- PROFINET DCP

def decode_profinet_dcp(frames: DataFrame) -> DataFrame:
    """DCP frames; offered as a decoder, no port leads to it."""
    P = F.col("payload")
    rows = frames.where(nbytes(P) >= 10)
    sid = u8(P, 0)
    high = sid == 4
    op = F.when(sid == 4, "CONFIG_WRITE").when(sid.isin(3, 5), "IDENTIFY").otherwise("OTHER")
    risk = _of(dims.DCP_SERVICES, sid, 2, F.lit("MEDIUM"))
    return _event(rows, "PROFINET_DCP", sid, _of(dims.DCP_SERVICES, sid, 0, F.concat(F.lit("DCP Unknown (0x"), _hex(sid, 2), F.lit(")"))),
                  _of(dims.DCP_SERVICES, sid, 1, F.lit("UNKNOWN")), risk, mitre=dims.techniques(dims.DCP_SERVICES, sid),
                  notes=F.concat(F.lit("ServiceType=0x"), _hex(u8(P, 1), 2)), score=F.when(high, 0.7).otherwise(0.2), entropy_from=0, change_at=2, detail=details(op))


DECODERS = {"MODBUS_TCP": decode_modbus, "S7COMM": decode_s7comm, "DNP3": decode_dnp3, "ENIP": decode_enip, "IEC_104": decode_iec104,
            "BACNET": decode_bacnet, "MQTT": decode_mqtt, "OPC_UA": decode_opcua}


def flow_timing_features(events: DataFrame, byte: str = "payload_byte") -> DataFrame:
    """Seconds since the last message of the same conversation and function, and change of one payload byte per second."""
    rows = running(events, ["src_ip", "dst_ip", "function_code"], {"_t": ("prev", F.col("ts_us")), "_b": ("prev", F.col(byte))})
    gap = F.coalesce((F.col("ts_us") - F.col("_t")) / 1e6, F.lit(0.0))
    return (rows.withColumn("time_since_last", gap)
            .withColumn("payload_change_rate", F.when((F.col("time_since_last") > 0) & F.col("_b").isNotNull() & F.col(byte).isNotNull(),
                                                      F.abs(F.col(byte) - F.col("_b")) / F.col("time_since_last")).otherwise(0.0))
            .drop("_t", "_b"))


def decode_events(pdus: DataFrame) -> DataFrame:
    """Events of all protocols; one filtered branch per decoder, so each reads only its messages."""
    pdus = stage(pdus)      # eight branches read it
    out = None
    for protocol, decoder in DECODERS.items():
        part = decoder(pdus.where(F.col("protocol") == protocol))
        out = part if out is None else out.unionByName(part)
    return flow_timing_features(out)
