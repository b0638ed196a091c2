"""Records to prose: formatters, item labels, the narrators of the record types, and their summaries.

A narrator is a Column over a record's fields, so Catalyst sees one expression per record. Deployments add
their own types as templates with ``{field}`` places, where formatters are named after a colon.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorikeet.functions import text as tx


def fmt_date(x: Column) -> Column:
    """``dd Month yyyy``; what isn't a date stays; nothing is ``-``."""
    text = F.nullif(x.cast("string"), F.lit(""))
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "dd MMMM yyyy"), text, F.lit("-"))


def fmt_time(x: Column, unknown: str = "unknown") -> Column:
    return F.when(F.coalesce(x, F.lit("")).isin("", "00:00:00"), F.lit(unknown)).otherwise(x)


def safe(x: Column, fallback: str = "-") -> Column:
    return F.coalesce(F.nullif(x.cast("string"), F.lit("")), F.lit(fallback))


def num(x: Column, fallback: str = "0") -> Column:
    """only null falls back; an empty string stays."""
    return F.coalesce(x.cast("string"), F.lit(fallback))


def join_list(items: Column, sep: str = ", ", last: str = " and ") -> Column:
    """no item: ``-``; one: itself; more: all but the last by ``sep``, then ``last``."""
    some = F.filter(items, lambda x: F.coalesce(x, F.lit("")) != "")
    n = F.size(some)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit("-")).when(n == 1, F.try_element_at(some, F.lit(1))).otherwise(F.concat(F.array_join(F.slice(some, 1, F.greatest(n - 1, F.lit(0))), sep), F.lit(last), F.try_element_at(some, F.lit(-1))))


def code_word(x: Column, words: dict[str, str]) -> Column:
    """the code's word, or the code in lower case."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in words.items() for v in kv]), F.trim(x)), F.lower(x))


def term_code(x: Column, odd: str = "Odd", even: str = "Even") -> Column:
    """a five-character code as year and term; others stay."""
    s = x.cast("string")
    term = F.substr(s, F.lit(5), F.lit(1))
    return F.when(F.length(s) == 5, F.concat(F.left(s, F.lit(4)), F.lit(" Semester "), F.when(term == "1", odd).when(term == "2", even).otherwise(term))).otherwise(s)


def slugify(x: Column, chars: int = 80) -> Column:
    """F8: letters, digits, ``_`` and ``-``; white space as ``_``."""
    bare = F.regexp_replace(F.regexp_replace(x.cast("string"), r"^\s+|\s+$", ""), r"(?U)[^\w\s\-]", "")
    return F.left(F.regexp_replace(bare, r"(?U)\s+", "_"), F.lit(chars))


#: The field that labels an item of each type; admissions are labelled by two.
LABEL_FIELDS = {
    "faculty": ("singkatan_fakultas",),
    "programme": ("nama_prodi",),
    "degree": ("kode_jenjang",),
    "curriculum": ("nama_kurikulum",),
    "course": ("kode_mk",),
    "prerequisite": ("kode_mk",),
    "class": ("nama_kelas",),
    "timetable": ("kode_mk",),
    "facility": ("nama_gedung",),
    "admission": ("jalur_masuk", "tahun_masuk"),
    "notice": ("judul",),
}


def item_label(index: Column, label: Column | None = None) -> Column:
    """the number with four digits and the slug of the label, or of the number."""
    text = index.cast("string")
    slug = slugify(F.coalesce(F.nullif(label.cast("string"), F.lit("")), text)) if label is not None else text
    return F.concat(F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text), F.lit("_"), slug)


def endpoint_label(endpoint: str, index: Column) -> Column:
    """F9 for a record type: its label field, or two joined by ``_``, which may be empty."""
    fields = LABEL_FIELDS.get(endpoint, ())
    if len(fields) > 1:
        return item_label(index, F.concat_ws("_", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))
    return item_label(index, F.col(fields[0]) if fields else None)


FORMATS: dict[str, Callable[[Column], Column]] = {"safe": safe, "num": num, "date": fmt_date, "time": fmt_time, "list": join_list, "term": lambda x: safe(term_code(x)), "raw": lambda x: F.coalesce(x.cast("string"), F.lit(""))}


def template(text: str) -> Column:
    """``{field}``, ``{field:format}``; ``[[...]]`` is left out where its first field is empty."""

    def plain(part: str) -> list[Column]:
        out = []
        for piece in re.split(r"(\{[^{}]+\})", part):
            if piece.startswith("{"):
                name, _, kind = piece[1:-1].partition(":")
                out.append(FORMATS[kind or "safe"](F.col(name)))
            elif piece:
                out.append(F.lit(piece))
        return out

    parts: list[Column] = []
    for piece in re.split(r"(\[\[.*?\]\])", text, flags=re.S):
        if piece.startswith("[["):
            first = re.search(r"\{([^{}:]+)", piece)[1]
            parts.append(F.when(F.coalesce(F.col(first).cast("string"), F.lit("")) != "", F.concat(*plain(piece[2:-2]))).otherwise(F.lit("")))
        else:
            parts += plain(piece)
    return F.concat(*parts)


# ---------------------------------------------------------------- F10-F21: narrators


def say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def only(condition: Column, *parts: str | Column) -> Column:
    """The parts where the condition holds, otherwise nothing."""
    return F.when(condition, say(*parts)).otherwise(F.lit(""))


def given(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) != ""


def known(name: str) -> Column:
    """Given, and not the dash that stands for nothing."""
    return given(name) & (F.col(name).cast("string") != "-")


def whole(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(0))


def flag(name: str) -> Column:
    return whole(name) != 0


def field(name: str, fallback: str = "-") -> Column:
    return safe(F.col(name), fallback)


def count(name: str) -> Column:
    return num(F.col(name))


def updated() -> Column:
    return say("\nLast updated on ", fmt_date(F.col("updated_at")), ".")


def contacts(kind: str) -> Column:
    """Phone, email and website, as far as they are given."""
    return F.array(*[only(given(f"{name}_{kind}"), f"{word} ", F.col(f"{name}_{kind}").cast("string")) for name, word in (("telepon", "phone"), ("email", "email"), ("website", "website"))])


def faculty() -> Column:
    ways = contacts("fakultas")
    reach = F.when(join_list(ways) != "-", say("It can be reached by ", join_list(ways), ".")).otherwise("No contact is known yet.")
    return say(field("nama_fakultas"), " (short: ", field("singkatan_fakultas"), ", code: ", field("kode_fakultas"), ") is a faculty", only(known("alamat_fakultas"), ", located at ", F.col("alamat_fakultas")), ".\n", reach, "\nIt has ", count("jumlah_prodi_fakultas"), " active programmes, ", count("jumlah_gedung_fakultas"), " buildings, ", count("jumlah_dosen_fakultas"), " lecturers, ", count("jumlah_mahasiswa_fakultas"), " students, ", count("jumlah_laboratorium_fakultas"), " laboratories and ", count("jumlah_kelas_fakultas"), " classes.", updated())


def programme() -> Column:
    ways = contacts("prodi")
    codes = F.array_compact(F.array(F.when(known("kode_dikti_prodi"), say("National code: ", F.col("kode_dikti_prodi").cast("string"))), F.when(known("kode_internal_prodi"), say("Internal code: ", F.col("kode_internal_prodi").cast("string")))))
    return say(
        *(field("nama_prodi"), " (", field("singkatan_prodi"), ") is a programme for the degree ", field("nama_jenjang"), " at the faculty ", field("nama_fakultas"), only(known("alamat_prodi"), ", located at ", F.col("alamat_prodi")), "."),
        *("\nStatus: ", F.when(flag("status_aktif_prodi"), "active").otherwise("inactive"), "."),
        only(F.size(codes) > 0, "\n", F.array_join(codes, " | "), "."),
        only(known("gelar_kelulusan_prodi"), "\nGraduates hold the title ", F.col("gelar_kelulusan_prodi"), "."),
        only(known("nama_kaprodi"), "\nIts head is ", F.col("nama_kaprodi"), "."),
        *("\nIt has ", count("jumlah_dosen_prodi"), " lecturers, ", count("jumlah_mahasiswa_prodi"), " active students, ", count("jumlah_kelas_prodi"), " classes and ", count("jumlah_mata_kuliah_prodi"), " courses."),
        only(join_list(ways) != "-", "\nMore can be learned by ", join_list(ways), "."),
        updated(),
    )


def degree() -> Column:
    length = F.when(F.col("maksimal_semester").isNotNull(), say("within at most ", F.col("maksimal_semester").cast("string"), " terms")).otherwise("in a time that is not set yet")
    return say(field("nama_jenjang"), " (", field("kode_jenjang"), ") is a degree that can be taken.\nStudents take at most ", count("maksimal_sks"), " credits a term, ", length, ".\nIn the first terms at most ", count("maksimal_sks_semester_awal"), " credits may be taken; the first evaluation is at the end of term ", count("batas_evaluasi_semester_awal"), ".\nIt has ", count("jumlah_prodi_jenjang"), " programmes and ", count("jumlah_mahasiswa_jenjang"), " students.", updated())


def curriculum() -> Column:
    n = lambda name: whole(name).cast("string")
    decree = F.when(known("nomor_sk_rektor") & (F.col("nomor_sk_rektor") != "0000"), say("by decree number ", F.col("nomor_sk_rektor"), " of ", fmt_date(F.col("tanggal_sk_rektor")))).otherwise("with no decree known yet")
    credits_ = F.when(whole("total_sks_lulus") > 0, say("To graduate takes ", n("total_sks_lulus"), " credits: ", n("total_sks_wajib"), " of required and ", n("total_sks_pilihan"), " of elective courses.")).otherwise("The credits to graduate are not known yet.")
    courses = F.when(whole("jumlah_mata_kuliah") > 0, say("It holds ", n("jumlah_mata_kuliah"), " courses: ", n("jumlah_mk_wajib"), " required and ", n("jumlah_mk_pilihan"), " elective.")).otherwise("Its courses are not known yet.")
    return say(field("nama_kurikulum"), " is an ", F.when(flag("status_aktif_kurikulum"), "active").otherwise("inactive"), " curriculum in force since ", count("tahun_berlaku"), " for the programme ", field("nama_program_studi"), ", ", decree, ".\n", credits_, "\nThe ideal time is ", count("masa_studi_ideal"), " terms, the longest ", count("masa_studi_maksimal"), ".\n", courses, updated())


COURSE_TYPES = {"P": "elective", "W": "required", "p": "elective", "w": "required"}


def course() -> Column:
    return say(field("nama_mk"), only(known("singkatan_mk"), " (", F.col("singkatan_mk"), ")"), " (code: ", field("kode_mk"), ") is a course of type ", code_word(field("mk_wajib_atau_pilihan"), COURSE_TYPES), ", taught ", F.lower(field("tipe_kelas_mk", "face to face")), ", in the package of term ", count("paket_mk_setiap_semester"), ".\nStatus: ", F.when(flag("status_mata_kuliah_aktif"), "active").otherwise("inactive"), ". It is ", F.when(flag("status_mata_kuliah_umum"), "a general course").otherwise("not a general course"), ".\nIt has ", count("jumlah_kelas"), " active classes with ", count("jumlah_mahasiswa"), " students.", updated())


def prerequisite() -> Column:
    amount = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    terms = F.array(only(amount("min_sks") > 0, "at least ", tx.number_text(amount("min_sks"), "0"), " credits"), only(amount("min_ipk") > 0, "a grade average of at least ", tx.number_text(amount("min_ipk"), "0.00")))
    names = F.transform(F.col("daftar_mk_prasyarat"), lambda m: F.coalesce(m["nama_mk"], F.lit("")))
    first = F.when(F.coalesce(F.size("daftar_mk_prasyarat"), F.lit(0)) > 0, say("These courses must be passed before: ", join_list(names), ".")).otherwise("No course must be passed before.")
    return say("Prerequisites of the course ", field("nama_mk"), " (code: ", field("kode_mk"), "):\n", F.when(join_list(terms) != "-", say("It takes ", join_list(terms), ".")).otherwise("No credits or grade average are asked for."), "\n", first, "\nNumber of courses to be passed before: ", count("jumlah_mk_prasyarat"), ".", updated())


def class_() -> Column:
    notes = F.array_join(F.array_compact(F.array(F.when(flag("is_batal"), "Note: this class is cancelled."), F.when(flag("is_blok"), "It is held as a block."), F.when(flag("is_antara_semester"), "It is held between terms."))), " ")
    return say(field("nama_kelas"), " is a class of type ", F.lower(field("jenis_kelas", "regular")), " of the course ", field("nama_mk"), " (code: ", field("kode_mk"), ") in the year ", field("tahun_ajaran"), ", term ", field("jenis_semester"), ", of the programme ", field("nama_prodi"), ".\nRoom for ", count("kapasitas_kelas"), " students; ", count("jumlah_peserta"), " take part, ", count("sisa_kuota"), " places are left.\n", F.when(notes != "", notes).otherwise("It runs as planned."), "\nIt is taught by ", count("jumlah_dosen_pengampu"), " lecturers.", updated())


UNSET = "not set yet"


def timetable() -> Column:
    start, end = (fmt_time(F.trim(F.col(c)), UNSET) for c in ("jam_mulai", "jam_selesai"))
    names = F.when(F.coalesce(F.size("nama_dosen"), F.lit(0)) > 0, join_list(F.col("nama_dosen"))).otherwise(UNSET)
    at = F.when(start != UNSET, say("from ", start, " to ", end)).otherwise(f"at a time {UNSET}")
    return say("The course ", field("nama_mk"), " (code: ", field("kode_mk"), ") meets for class ", field("nama_kelas"), " on ", field("hari"), " ", at, " in ", field("nama_ruang"), ", building ", field("nama_gedung"), ".\nYear ", field("tahun_ajaran"), ", term ", field("jenis_semester"), ", kind of meeting: ", F.lower(field("jenis_pertemuan")), ".\nPlaces of the slot: ", count("kapasitas_slot"), "; of the room: ", count("kapasitas_ruang"), ".\nLecturers: ", names, ".", updated())


def facility() -> Column:
    rooms = rooms_text(F.col("daftar_ruangan"))
    return say(field("nama_gedung"), " is a building of the faculty ", field("nama_fakultas"), ".\nIt has ", count("jumlah_ruangan_gedung"), " rooms for ", count("total_kapasitas_gedung"), " people, of which ", count("jumlah_ruangan_kuliah_gedung"), " are lecture rooms (", count("jumlah_ruangan_layak_gedung"), " fit for use).", only(flag("status_mku"), "\nGeneral courses are held here as well."), only(rooms != "", "\n", rooms), updated())


def admission() -> Column:
    path, note = field("jalur_masuk"), field("keterangan_jalur")
    seats = F.col("jumlah_per_prodi_per_jalur_per_tahun")
    return say("The admission path ", path, only((note != path) & (note != "-"), " (", note, ")"), " is open for ", F.when(given("tahun_masuk"), term_code(F.col("tahun_masuk"))).otherwise("-"), ", degree ", field("jenjang"), ".\nIt admits ", count("jumlah_diterima_per_jalur_per_tahun"), " students to ", F.greatest(F.coalesce(F.size(seats), F.lit(0)), F.lit(0)).cast("string"), " programmes.\n", quota_text(seats), updated())


def notice() -> Column:
    return say("[Notice]\nTitle: ", field("judul"), "\nDate: ", fmt_date(F.col("tanggal")), "\n\n", field("isi"), "\n", updated())


def metadata() -> Column:
    return say("[Metadata]\nVersion: ", field("version"), "\nLast updated: ", fmt_date(F.col("last_updated")), "\nDescription: ", field("description"), "\n")


def rooms_text(rooms: Column, most: int = 5) -> Column:
    """Rooms of a building: all up to ``most``, otherwise the first as an example."""

    def room(r: Column, exams: bool) -> Column:
        equipment, seats = join_list(r["daftar_fasilitas"]), F.coalesce(r["daya_tampung_ujian"], F.lit(0))
        return say(safe(r["nama_ruangan"]), " (code ", safe(r["kode_ruangan"]), ", floor ", safe(r["lantai"]), ", for ", num(r["daya_tampung"]), *((only(seats > 0, ", ", seats.cast("string"), " in exams"),) if exams else ()), only(equipment != "-", ", with ", equipment), ")")

    n = F.coalesce(F.size(rooms), F.lit(0))
    every = say("Rooms:\n", F.array_join(F.transform(rooms, lambda r: say("  - ", room(r, True))), "\n"))
    example = say("For example: ", F.try_element_at(F.transform(F.slice(rooms, 1, 1), lambda r: room(r, False)), F.lit(1)), ".")
    return F.when(n <= 0, F.lit("")).when(n <= most, every).otherwise(example)


def quota_text(quota: Column) -> Column:
    """Seats per programme: texts with both."""
    return F.when(F.coalesce(F.size(quota), F.lit(0)) <= 0, F.lit("Seats per programme are not known yet.")).otherwise(say("Seats per programme: ", join_list(quota), "."))


def seat_texts(quota: Column) -> Column:
    """Structs (nama_prodi, jumlah_diterima) as texts."""
    return F.transform(quota, lambda q: say(safe(q["nama_prodi"]), " (", num(q["jumlah_diterima"]), " seats)"))


#: The record types, with the fields that they may have; keys that carry an institution's name are read without it.
FIELDS: dict[str, str] = {
    "faculty": "nama_fakultas string, singkatan_fakultas string, kode_fakultas string, alamat_fakultas string, telepon_fakultas string, email_fakultas string, website_fakultas string, jumlah_prodi_fakultas long, jumlah_gedung_fakultas long, jumlah_dosen_fakultas long, jumlah_mahasiswa_fakultas long, jumlah_laboratorium_fakultas long, jumlah_kelas_fakultas long, updated_at string",
    "programme": "nama_prodi string, singkatan_prodi string, nama_jenjang string, nama_fakultas string, alamat_prodi string, kode_dikti_prodi string, kode_internal_prodi string, gelar_kelulusan_prodi string, nama_kaprodi string, status_aktif_prodi long, telepon_prodi string, email_prodi string, website_prodi string, jumlah_dosen_prodi long, jumlah_mahasiswa_prodi long, jumlah_kelas_prodi long, jumlah_mata_kuliah_prodi long, updated_at string",
    "degree": "kode_jenjang string, nama_jenjang string, maksimal_sks long, maksimal_semester long, maksimal_sks_semester_awal long, batas_evaluasi_semester_awal long, jumlah_prodi_jenjang long, jumlah_mahasiswa_jenjang long, updated_at string",
    "curriculum": "nama_kurikulum string, tahun_berlaku long, nama_program_studi string, nomor_sk_rektor string, tanggal_sk_rektor string, status_aktif_kurikulum long, total_sks_lulus long, total_sks_wajib long, total_sks_pilihan long, jumlah_mata_kuliah long, jumlah_mk_wajib long, jumlah_mk_pilihan long, masa_studi_ideal long, masa_studi_maksimal long, updated_at string",
    "course": "nama_mk string, kode_mk string, singkatan_mk string, mk_wajib_atau_pilihan string, tipe_kelas_mk string, paket_mk_setiap_semester long, status_mata_kuliah_umum long, status_mata_kuliah_aktif long, jumlah_kelas long, jumlah_mahasiswa long, updated_at string",
    "prerequisite": "nama_mk string, kode_mk string, min_sks double, min_ipk double, daftar_mk_prasyarat array<struct<nama_mk:string>>, jumlah_mk_prasyarat long, updated_at string",
    "class": "is_batal long, is_blok long, is_antara_semester long, nama_kelas string, jenis_kelas string, nama_mk string, kode_mk string, tahun_ajaran string, jenis_semester string, nama_prodi string, kapasitas_kelas long, jumlah_peserta long, sisa_kuota long, jumlah_dosen_pengampu long, updated_at string",
    "timetable": "nama_dosen array<string>, jam_mulai string, jam_selesai string, nama_mk string, kode_mk string, nama_kelas string, hari string, nama_ruang string, nama_gedung string, tahun_ajaran string, jenis_semester string, jenis_pertemuan string, kapasitas_slot long, kapasitas_ruang long, updated_at string",
    "facility": "nama_gedung string, nama_fakultas string, status_mku long, daftar_ruangan array<struct<nama_ruangan:string,kode_ruangan:string,lantai:string,daya_tampung:long,daya_tampung_ujian:long,daftar_fasilitas:array<string>>>, jumlah_ruangan_gedung long, total_kapasitas_gedung long, jumlah_ruangan_kuliah_gedung long, jumlah_ruangan_layak_gedung long, updated_at string",
    "admission": "jalur_masuk string, keterangan_jalur string, tahun_masuk string, jenjang string, jumlah_diterima_per_jalur_per_tahun long, jumlah_per_prodi_per_jalur_per_tahun array<string>, updated_at string",
    "notice": "judul string, tanggal string, isi string, updated_at string",
    "metadata": "version string, last_updated string, description string",
}
NARRATORS: dict[str, Callable[[], Column] | str] = {"faculty": faculty, "programme": programme, "degree": degree, "curriculum": curriculum, "course": course, "prerequisite": prerequisite, "class": class_, "timetable": timetable, "facility": facility, "admission": admission, "notice": notice, "metadata": metadata}

#: The file of each record type.
FILE_MAP = {"fakultas.json": "faculty", "prodi.json": "programme", "jenjang.json": "degree", "kurikulum.json": "curriculum", "mata-kuliah.json": "course", "prasyarat.json": "prerequisite", "kelas.json": "class", "jadwal.json": "timetable", "fasilitas.json": "facility", "pmb.json": "admission", "pengumuman.json": "notice", "metadata.json": "metadata"}


def with_fields(records: DataFrame, endpoint: str) -> DataFrame:
    """Records with all fields of their type; those that they lack are null. Seats that are structs become texts."""
    seats = "jumlah_per_prodi_per_jalur_per_tahun"
    if endpoint == "admission" and seats in records.columns and "struct" in records.schema[seats].dataType.simpleString():
        records = records.withColumn(seats, seat_texts(F.col(seats)))
    for part in re.split(r", (?=[a-z_]+ )", FIELDS.get(endpoint, "")):
        name, _, kind = part.partition(" ")
        if name and name not in records.columns:
            records = records.withColumn(name, F.lit(None).cast(kind))
    return records


def narrate(records: DataFrame, endpoint: str, registry: dict = NARRATORS) -> DataFrame:
    """Adds ``narrative``; fields that the records lack count as null."""
    how = registry[endpoint]
    if not isinstance(how, str):
        return with_fields(records, endpoint).withColumn("narrative", how())
    for name in dict.fromkeys(re.findall(r"\{([^{}:]+)", how)):
        if name not in records.columns:
            records = records.withColumn(name, F.lit(None).cast("string"))
    return records.withColumn("narrative", template(how))


# ---------------------------------------------------------------- F22-F32, A15: summaries

#: What a summary says of each type; a number that is missing reads ``?``.
SUMMARIES: dict[str, str] = {
    "faculty": "There are {jumlah_fakultas} faculties with {jumlah_prodi} programmes, {jumlah_gedung} buildings and {jumlah_dosen} lecturers.",
    "programme": "There are {jumlah_prodi_total} programmes with {jumlah_mahasiswa_total} students and {jumlah_dosen_total} lecturers.",
    "degree": "There are {jumlah_jenjang} degrees.",
    "curriculum": "There are {jumlah_kurikulum} curricula, of which {jumlah_kurikulum_aktif} are active.",
    "course": "There are {jumlah_mata_kuliah} courses: {jumlah_mk_wajib} required and {jumlah_mk_pilihan} elective.",
    "prerequisite": "There are {jumlah_mata_kuliah_prasyarat} courses with prerequisites and {jumlah_mk_tanpa_prasyarat} without.",
    "class": "There are {jumlah_kelas_aktif} active classes and {jumlah_kelas_batal} cancelled ones.{per_semester}",
    "timetable": "The timetable: {per_hari}{jumlah_ruang_terpakai} rooms are used and {jumlah_dosen_mengajar} lecturers teach.",
    "facility": "There are {jumlah_gedung} buildings with {jumlah_ruangan} rooms for {total_kapasitas} people; {jumlah_ruangan_kuliah} are lecture rooms, of which {jumlah_ruangan_layak} are fit for use.",
    "admission": "There are {jumlah_jalur_masuk} admission paths.",
    "notice": "There are {jumlah_pengumuman} notices.",
}
#: Parts of a summary that are nothing, not ``?``, where they are missing.
OPTIONAL = ("per_semester", "per_hari")


def per_day(days: Column) -> Column:
    """A map of day to entries as the part of a summary; days in their order in the map."""
    text = F.array_join(F.transform(F.map_entries(days), lambda e: say(e["key"], ": ", e["value"].cast("string"))), ", ")
    return F.when(F.coalesce(F.size(days), F.lit(0)) > 0, say("entries by day: ", text, ". ")).otherwise(F.lit(""))


def per_term(terms: Column, most: int = 5) -> Column:
    """Structs (tahun_ajaran, jenis_semester, jumlah_kelas) as the part of a summary; the first ``most``."""
    text = F.array_join(F.transform(F.slice(terms, 1, most), lambda t: say(F.coalesce(t["tahun_ajaran"], F.lit("")), " ", F.coalesce(t["jenis_semester"], F.lit("")), ": ", F.coalesce(t["jumlah_kelas"], F.lit(0)).cast("string"))), " | ")
    return F.when(F.coalesce(F.size(terms), F.lit(0)) > 0, say(" By term: ", text, ".")).otherwise(F.lit(""))


def summarise(counts: dict[str, Column], endpoint: str, registry: dict[str, str] = SUMMARIES) -> Column:
    """The summary from the counts that are known. Without a number of notices, or with 0, theirs is empty."""
    parts = []
    for piece in re.split(r"(\{[^{}]+\})", registry[endpoint]):
        name = piece[1:-1]
        if not piece.startswith("{"):
            parts.append(F.lit(piece))
        else:
            parts.append(F.coalesce(counts[name].cast("string") if name in counts else F.lit(None).cast("string"), F.lit("" if name in OPTIONAL else "?")))
    text = F.concat(*parts)
    if endpoint == "notice" and registry is SUMMARIES:
        n = counts.get("jumlah_pengumuman", F.lit(None)).cast("long")
        return F.when(F.coalesce(n, F.lit(0)) != 0, text).otherwise(F.lit(""))
    return text


def roll_up(records: DataFrame, endpoint: str) -> DataFrame:
    """One row with the numbers that the type's summary says, from its records."""
    r = with_fields(records, endpoint)
    n, total = F.count(F.lit(1)), lambda name: F.coalesce(F.sum(name), F.lit(0))
    if endpoint == "timetable":
        days = r.where(given("hari")).groupBy("hari").agg(n.alias("n"))
        days = days.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("hari", "n")))).alias("days"))  # a row per weekday
        used = r.agg(F.count_distinct(F.nullif("nama_ruang", F.lit(""))).alias("jumlah_ruang_terpakai"))
        teach = r.select(F.explode("nama_dosen").alias("who")).where("who <> ''").agg(F.count_distinct("who").alias("jumlah_dosen_mengajar"))
        return used.join(teach).join(days).select("jumlah_ruang_terpakai", "jumlah_dosen_mengajar", per_day(F.col("days")).alias("per_hari"))
    if endpoint == "class":
        live = r.groupBy("tahun_ajaran", "jenis_semester").agg(n.alias("jumlah_kelas"), F.count_if(~flag("is_batal")).alias("live"), F.count_if(flag("is_batal")).alias("gone"))
        newest = F.reverse(F.array_sort(F.collect_list(F.struct("tahun_ajaran", "jenis_semester", "jumlah_kelas"))))  # a row per term
        return live.agg(total("live").alias("jumlah_kelas_aktif"), total("gone").alias("jumlah_kelas_batal"), per_term(newest).alias("per_semester"))
    aggs = {
        "faculty": {"jumlah_fakultas": n, "jumlah_prodi": total("jumlah_prodi_fakultas"), "jumlah_gedung": total("jumlah_gedung_fakultas"), "jumlah_dosen": total("jumlah_dosen_fakultas")},
        "programme": {"jumlah_prodi_total": n, "jumlah_mahasiswa_total": total("jumlah_mahasiswa_prodi"), "jumlah_dosen_total": total("jumlah_dosen_prodi")},
        "degree": {"jumlah_jenjang": n},
        "curriculum": {"jumlah_kurikulum": n, "jumlah_kurikulum_aktif": F.count_if(flag("status_aktif_kurikulum"))},
        "course": {"jumlah_mata_kuliah": n, "jumlah_mk_wajib": F.count_if(F.upper(F.trim("mk_wajib_atau_pilihan")) == "W"), "jumlah_mk_pilihan": F.count_if(F.upper(F.trim("mk_wajib_atau_pilihan")) == "P")},
        "prerequisite": {"jumlah_mata_kuliah_prasyarat": F.count_if(whole("jumlah_mk_prasyarat") > 0), "jumlah_mk_tanpa_prasyarat": F.count_if(whole("jumlah_mk_prasyarat") <= 0)},
        "facility": {"jumlah_gedung": n, "jumlah_ruangan": total("jumlah_ruangan_gedung"), "total_kapasitas": total("total_kapasitas_gedung"), "jumlah_ruangan_kuliah": total("jumlah_ruangan_kuliah_gedung"), "jumlah_ruangan_layak": total("jumlah_ruangan_layak_gedung")},
        "admission": {"jumlah_jalur_masuk": F.count_distinct(F.nullif("jalur_masuk", F.lit("")))},
        "notice": {"jumlah_pengumuman": n},
    }[endpoint]
    return r.agg(*[c.alias(k) for k, c in aggs.items()])


def summary(records: DataFrame, endpoint: str) -> DataFrame:
    """``summary``: one row, rolled up from the records."""
    row = roll_up(records, endpoint)
    return row.select(summarise({c: F.col(c) for c in row.columns}, endpoint).alias("summary"))
