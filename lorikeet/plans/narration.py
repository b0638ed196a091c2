"""Queries over the record types: records made of the driver's tables by one list of expressions, which both
sides read, then told by the narrators here and by SQL of its own there."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorikeet.functions import records as rec
from lorikeet.plans.catalogue import query
from lorikeet.sources.readers import table

_DAY = "CASE k % 4 WHEN 0 THEN '2026-03-05' WHEN 1 THEN '2025-11-30T08:15:00' WHEN 2 THEN 'soon' END"
_TERM = "concat('202', k % 4, '/202', k % 4 + 1)"

#: Table, key, and fields as expressions over the key ``k`` and the name ``x`` that Spark and DuckDB read alike.
RECORDS: dict[str, tuple[str, str, str, dict[str, str]]] = {
    "faculty": ("nation", "n_nationkey", "n_name", {"nama_fakultas": "x", "singkatan_fakultas": "CASE WHEN k % 4 <> 0 THEN lower(x) ELSE '' END", "kode_fakultas": "concat('F', k)", "alamat_fakultas": "CASE k % 3 WHEN 0 THEN concat('Road ', k) WHEN 1 THEN '-' END", "telepon_fakultas": "CASE WHEN k % 2 = 0 THEN concat('0', k) END", "email_fakultas": "CASE WHEN k % 3 = 0 THEN concat(lower(x), '@x') END", "website_fakultas": "CASE WHEN k % 5 = 0 THEN concat(lower(x), '.y') ELSE '' END", "jumlah_prodi_fakultas": "CASE WHEN k % 7 <> 0 THEN k END", "jumlah_gedung_fakultas": "k % 5", "jumlah_dosen_fakultas": "k * 3", "jumlah_mahasiswa_fakultas": "k * 100", "jumlah_laboratorium_fakultas": "k % 2", "updated_at": _DAY}),
    "programme": ("supplier", "s_suppkey", "s_name", {"nama_prodi": "x", "singkatan_prodi": "concat('P', k)", "nama_jenjang": "CASE WHEN k % 6 <> 0 THEN 'S1' END", "nama_fakultas": "concat('F', k % 9)", "alamat_prodi": "CASE WHEN k % 3 = 0 THEN concat('Road ', k) END", "kode_dikti_prodi": "CASE WHEN k % 2 = 0 THEN concat('D', k) END", "kode_internal_prodi": "CASE WHEN k % 3 = 0 THEN concat('U', k) ELSE '-' END", "gelar_kelulusan_prodi": "CASE WHEN k % 4 = 0 THEN 'B.Sc.' ELSE '' END", "nama_kaprodi": "CASE WHEN k % 5 = 0 THEN concat('Dr. ', k) END", "status_aktif_prodi": "CASE WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 1 THEN 0 END", "email_prodi": "CASE WHEN k % 2 = 1 THEN concat('p', k, '@x') END", "website_prodi": "CASE WHEN k % 4 = 1 THEN concat('p', k, '.y') END", "jumlah_dosen_prodi": "k % 40", "jumlah_mahasiswa_prodi": "k * 7", "jumlah_mata_kuliah_prodi": "k % 50", "updated_at": _DAY}),
    "degree": ("region", "r_regionkey", "r_name", {"kode_jenjang": "concat('S', k)", "nama_jenjang": "x", "maksimal_sks": "20 + k", "maksimal_semester": "CASE WHEN k % 2 = 0 THEN 8 + k END", "maksimal_sks_semester_awal": "CASE WHEN k <> 3 THEN 18 END", "batas_evaluasi_semester_awal": "k", "jumlah_prodi_jenjang": "k * 5", "jumlah_mahasiswa_jenjang": "k * 1000", "updated_at": _DAY}),
    "curriculum": ("part", "p_partkey", "p_name", {"nama_kurikulum": "x", "tahun_berlaku": "2010 + k % 16", "nama_program_studi": "concat('P', k % 30)", "nomor_sk_rektor": "CASE k % 4 WHEN 0 THEN '0000' WHEN 1 THEN concat('SK/', k) WHEN 2 THEN '-' END", "tanggal_sk_rektor": "CASE WHEN k % 8 = 1 THEN '2020-01-31' END", "status_aktif_kurikulum": "k % 2", "total_sks_lulus": "CASE WHEN k % 3 <> 0 THEN 140 + k % 9 END", "total_sks_wajib": "120", "total_sks_pilihan": "20 + k % 9", "jumlah_mata_kuliah": "CASE WHEN k % 5 <> 0 THEN 50 + k % 7 END", "jumlah_mk_wajib": "40", "jumlah_mk_pilihan": "10 + k % 7", "masa_studi_ideal": "8", "updated_at": _DAY}),
    "course": ("part", "p_partkey", "p_name", {"nama_mk": "x", "kode_mk": "concat('MK', k)", "singkatan_mk": "CASE k % 3 WHEN 0 THEN concat('m', k) WHEN 1 THEN '-' END", "mk_wajib_atau_pilihan": "CASE k % 5 WHEN 0 THEN 'W' WHEN 1 THEN 'P ' WHEN 2 THEN 'w' WHEN 3 THEN 'OTHER' END", "tipe_kelas_mk": "CASE WHEN k % 2 = 0 THEN 'ONLINE' END", "paket_mk_setiap_semester": "1 + k % 8", "status_mata_kuliah_umum": "k % 2", "status_mata_kuliah_aktif": "CASE WHEN k % 4 <> 0 THEN 1 END", "jumlah_kelas": "k % 6", "jumlah_mahasiswa": "k % 200", "updated_at": _DAY}),
    "prerequisite": ("part", "p_partkey", "p_name", {"nama_mk": "x", "kode_mk": "concat('MK', k)", "min_sks": "CASE k % 3 WHEN 0 THEN 100.0 + k % 50 WHEN 1 THEN 0.0 END", "min_ipk": "CASE WHEN k % 2 = 0 THEN 2.25 END", "jumlah_mk_prasyarat": "k % 4", "updated_at": _DAY}),
    "class": ("supplier", "s_suppkey", "s_name", {"is_batal": "CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END", "is_blok": "CASE WHEN k % 3 = 0 THEN 1 END", "is_antara_semester": "CASE WHEN k % 2 = 0 THEN 1 END", "nama_kelas": "x", "jenis_kelas": "CASE WHEN k % 4 <> 0 THEN 'EVENING' END", "nama_mk": "concat('Course ', k % 50)", "kode_mk": "concat('MK', k % 50)", "tahun_ajaran": _TERM, "jenis_semester": "CASE WHEN k % 2 = 0 THEN 'odd' ELSE 'even' END", "nama_prodi": "concat('P', k % 30)", "kapasitas_kelas": "40", "jumlah_peserta": "k % 41", "sisa_kuota": "40 - k % 41", "updated_at": _DAY}),
    "timetable": ("supplier", "s_suppkey", "s_name", {"jam_mulai": "CASE k % 4 WHEN 0 THEN '00:00:00' WHEN 1 THEN ' 08:00:00' WHEN 2 THEN '' ELSE '10:00:00' END", "jam_selesai": "CASE WHEN k % 3 <> 0 THEN '12:00:00' END", "nama_mk": "x", "kode_mk": "concat('MK', k)", "nama_kelas": "CASE WHEN k % 7 <> 0 THEN concat('K', k % 9) END", "hari": "CASE k % 6 WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tuesday' WHEN 2 THEN 'Friday' WHEN 3 THEN '' ELSE 'Sunday' END", "nama_ruang": "CASE WHEN k % 8 <> 0 THEN concat('R', k % 20) END", "nama_gedung": "concat('G', k % 4)", "tahun_ajaran": _TERM, "jenis_semester": "'odd'", "jenis_pertemuan": "CASE WHEN k % 2 = 0 THEN 'LECTURE' END", "kapasitas_slot": "k % 50", "updated_at": _DAY}),
    "facility": ("nation", "n_nationkey", "n_name", {"nama_gedung": "x", "nama_fakultas": "CASE WHEN k % 5 <> 0 THEN concat('F', k % 9) END", "status_mku": "k % 2", "jumlah_ruangan_gedung": "k % 7", "total_kapasitas_gedung": "k * 30", "jumlah_ruangan_kuliah_gedung": "k % 5", "jumlah_ruangan_layak_gedung": "CASE WHEN k % 3 <> 0 THEN k % 4 END", "updated_at": _DAY}),
    "admission": ("nation", "n_nationkey", "n_name", {"jalur_masuk": "CASE WHEN k % 9 <> 0 THEN x END", "keterangan_jalur": "CASE k % 3 WHEN 0 THEN x WHEN 1 THEN concat('by test ', k) END", "tahun_masuk": "CASE k % 4 WHEN 0 THEN '20261' WHEN 1 THEN '20252' WHEN 2 THEN '2024' END", "jenjang": "'S1'", "jumlah_diterima_per_jalur_per_tahun": "CASE WHEN k % 2 = 0 THEN k * 10 END", "updated_at": _DAY}),
    "notice": ("orders", "o_orderkey", "o_orderpriority", {"judul": "concat('Notice ', k)", "tanggal": _DAY, "isi": "CASE WHEN k % 5 <> 0 THEN x ELSE '' END", "updated_at": _DAY}),
    "metadata": ("region", "r_regionkey", "r_name", {"version": "CASE WHEN k <> 1 THEN concat('1.', k) END", "last_updated": _DAY, "description": "CASE WHEN k % 2 = 0 THEN x END"}),
}
#: Fields that are lists, in either dialect: (Spark, DuckDB).
NESTED: dict[str, dict[str, tuple[str, str]]] = {
    "prerequisite": {"daftar_mk_prasyarat": ("CASE WHEN k % 4 > 0 THEN transform(sequence(1, k % 4), i -> named_struct('nama_mk', concat('C', i))) END", "CASE WHEN k % 4 > 0 THEN list_transform(range(1, k % 4 + 1), lambda i: concat('C', i)) END")},
    "timetable": {"nama_dosen": ("CASE WHEN k % 4 > 0 THEN transform(sequence(1, k % 4), i -> CASE WHEN i = 3 THEN '' ELSE concat('L', k % 10 + i) END) END", "CASE WHEN k % 4 > 0 THEN list_transform(range(1, k % 4 + 1), lambda i: CASE WHEN i = 3 THEN '' ELSE concat('L', k % 10 + i) END) END")},
    "facility": {"daftar_ruangan": ("CASE WHEN k % 7 > 0 THEN transform(sequence(1, k % 7), i -> named_struct('nama_ruangan', concat('R', i), 'kode_ruangan', concat('c', i), 'lantai', CASE WHEN i % 2 = 0 THEN concat(i) END, 'daya_tampung', i * 10, 'daya_tampung_ujian', CASE WHEN i % 3 = 0 THEN i * 5 ELSE 0 END, 'daftar_fasilitas', CASE i % 3 WHEN 0 THEN array('tv', 'board') WHEN 1 THEN array('tv') END)) END", "k % 7")},
    "admission": {"jumlah_per_prodi_per_jalur_per_tahun": ("CASE WHEN k % 4 > 0 THEN transform(sequence(1, k % 4), i -> named_struct('nama_prodi', concat('P', i), 'jumlah_diterima', CASE WHEN i <> 2 THEN i * 5 END)) END", "CASE WHEN k % 4 > 0 THEN list_transform(range(1, k % 4 + 1), lambda i: concat('P', i, ' (', CASE WHEN i <> 2 THEN i * 5 ELSE 0 END, ' seats)')) END")},
}


def records(spark, sf_dir, endpoint):
    source, key, name, fields = RECORDS[endpoint]
    base = table(spark, sf_dir, source).select(F.col(key).cast("long").alias("k"), F.col(name).alias("x"))
    nested = {f: e[0] for f, e in NESTED.get(endpoint, {}).items()}
    return base.select("k", *[F.expr(e).alias(f) for f, e in (fields | nested).items()])


def _rows(endpoint: str) -> str:
    source, key, name, fields = RECORDS[endpoint]
    nested = {f: e[1] for f, e in NESTED.get(endpoint, {}).items()}
    return f"WITH b AS (SELECT {key}::BIGINT AS k, {name} AS x FROM {source}), r AS (SELECT k, {', '.join(f'{e} AS {f}' for f, e in (fields | nested).items())} FROM b)"


def _s(name: str, fallback: str = "-") -> str:
    return f"coalesce(nullif({name}::VARCHAR, ''), '{fallback}')"


def _n(name: str) -> str:
    return f"coalesce({name}::VARCHAR, '0')"


def _d(name: str) -> str:
    return f"CASE WHEN coalesce({name}, '') = '' THEN '-' ELSE coalesce(strftime(try_cast({name} AS TIMESTAMP), '%d %B %Y'), {name}) END"


def _list(items: str) -> str:
    some = f"list_filter({items}, lambda i: i <> '')"
    return f"CASE coalesce(len({some}), 0) WHEN 0 THEN '-' WHEN 1 THEN {some}[1] ELSE array_to_string({some}[1:-2], ', ') || ' and ' || {some}[-1] END"


def _tell(endpoint: str, *parts: str, key: bool = True) -> str:
    """Parts are SQL; what begins with ' stands for itself."""
    return f"{_rows(endpoint)} SELECT k AS key, concat({', '.join(parts)}) AS narrative FROM r"


_UPDATED = ("chr(10)", "'Last updated on '", _d("updated_at"), "'.'")
_NL = "chr(10)"


def _contacts(kind: str, phone: bool = True) -> str:
    ways = [f"CASE WHEN {n}_{kind} <> '' THEN '{w} ' || {n}_{kind} ELSE '' END" for n, w in (("telepon", "phone"), ("email", "email"), ("website", "website")) if phone or n != "telepon"]
    return f"[{', '.join(ways)}]"


def _room(i: str, exams: bool) -> str:
    seats = f"CASE WHEN {i} % 3 = 0 THEN concat(', ', {i} * 5, ' in exams') ELSE '' END, " if exams else ""
    return f"concat('R', {i}, ' (code c', {i}, ', floor ', CASE WHEN {i} % 2 = 0 THEN {i}::VARCHAR ELSE '-' END, ', for ', {i} * 10, {seats}CASE {i} % 3 WHEN 0 THEN ', with tv and board' WHEN 1 THEN ', with tv' ELSE '' END, ')')"


NARRATIVES: dict[str, str] = {
    "faculty": _tell("faculty", _s("nama_fakultas"), "' (short: '", _s("singkatan_fakultas"), "', code: '", _s("kode_fakultas"), "') is a faculty'", "CASE WHEN alamat_fakultas LIKE 'Road%' THEN ', located at ' || alamat_fakultas ELSE '' END", "'.'", _NL, f"CASE WHEN k % 2 = 0 OR k % 3 = 0 OR k % 5 = 0 THEN 'It can be reached by ' || {_list(_contacts('fakultas'))} || '.' ELSE 'No contact is known yet.' END", _NL, "'It has '", _n("jumlah_prodi_fakultas"), "' active programmes, '", "k % 5", "' buildings, '", "k * 3", "' lecturers, '", "k * 100", "' students, '", "k % 2", "' laboratories and 0 classes.'", *_UPDATED),
    "programme": _tell("programme", "nama_prodi", "' ('", "singkatan_prodi", "') is a programme for the degree '", _s("nama_jenjang"), "' at the faculty '", "nama_fakultas", "CASE WHEN k % 3 = 0 THEN concat(', located at Road ', k) ELSE '' END", "'.'", _NL, "'Status: '", "CASE WHEN k % 3 = 0 THEN 'active' ELSE 'inactive' END", "'.'", "CASE WHEN k % 6 = 0 THEN concat(chr(10), 'National code: D', k, ' | Internal code: U', k, '.') WHEN k % 2 = 0 THEN concat(chr(10), 'National code: D', k, '.') WHEN k % 3 = 0 THEN concat(chr(10), 'Internal code: U', k, '.') ELSE '' END", "CASE WHEN k % 4 = 0 THEN chr(10) || 'Graduates hold the title B.Sc..' ELSE '' END", "CASE WHEN k % 5 = 0 THEN concat(chr(10), 'Its head is Dr. ', k, '.') ELSE '' END", _NL, "'It has '", "k % 40", "' lecturers, '", "k * 7", "' active students, 0 classes and '", "k % 50", "' courses.'", f"CASE WHEN k % 2 = 1 THEN chr(10) || 'More can be learned by ' || {_list(_contacts('prodi', False))} || '.' ELSE '' END", *_UPDATED),
    "degree": _tell("degree", "nama_jenjang", "' ('", "kode_jenjang", "') is a degree that can be taken.'", _NL, "'Students take at most '", "20 + k", "' credits a term, '", "CASE WHEN k % 2 = 0 THEN concat('within at most ', 8 + k, ' terms') ELSE 'in a time that is not set yet' END", "'.'", _NL, "'In the first terms at most '", "CASE WHEN k <> 3 THEN 18 ELSE 0 END", "' credits may be taken; the first evaluation is at the end of term '", "k", "'.'", _NL, "'It has '", "k * 5", "' programmes and '", "k * 1000", "' students.'", *_UPDATED),
    "curriculum": _tell("curriculum", "nama_kurikulum", "' is an '", "CASE WHEN k % 2 = 1 THEN 'active' ELSE 'inactive' END", "' curriculum in force since '", "tahun_berlaku", "' for the programme '", "nama_program_studi", "', '", "CASE WHEN k % 4 = 1 THEN concat('by decree number SK/', k, ' of ', CASE WHEN k % 8 = 1 THEN '31 January 2020' ELSE '-' END) ELSE 'with no decree known yet' END", "'.'", _NL, "CASE WHEN k % 3 <> 0 THEN concat('To graduate takes ', total_sks_lulus, ' credits: 120 of required and ', total_sks_pilihan, ' of elective courses.') ELSE 'The credits to graduate are not known yet.' END", _NL, "'The ideal time is 8 terms, the longest 0.'", _NL, "CASE WHEN k % 5 <> 0 THEN concat('It holds ', jumlah_mata_kuliah, ' courses: 40 required and ', jumlah_mk_pilihan, ' elective.') ELSE 'Its courses are not known yet.' END", *_UPDATED),
    "course": _tell("course", "nama_mk", "CASE WHEN k % 3 = 0 THEN concat(' (m', k, ')') ELSE '' END", "' (code: '", "kode_mk", "') is a course of type '", "CASE k % 5 WHEN 0 THEN 'required' WHEN 1 THEN 'elective' WHEN 2 THEN 'required' WHEN 3 THEN 'other' ELSE '-' END", "', taught '", "CASE WHEN k % 2 = 0 THEN 'online' ELSE 'face to face' END", "', in the package of term '", "1 + k % 8", "'.'", _NL, "'Status: '", "CASE WHEN k % 4 <> 0 THEN 'active' ELSE 'inactive' END", "'. It is '", "CASE WHEN k % 2 = 1 THEN 'a' ELSE 'not a' END", "' general course.'", _NL, "'It has '", "k % 6", "' active classes with '", "k % 200", "' students.'", *_UPDATED),
    "prerequisite": _tell("prerequisite", "'Prerequisites of the course '", "nama_mk", "' (code: '", "kode_mk", "'):'", _NL, "CASE WHEN k % 6 = 0 THEN concat('It takes at least ', 100 + k % 50, ' credits and a grade average of at least 2.25.') WHEN k % 3 = 0 THEN concat('It takes at least ', 100 + k % 50, ' credits.') WHEN k % 2 = 0 THEN 'It takes a grade average of at least 2.25.' ELSE 'No credits or grade average are asked for.' END", _NL, f"CASE WHEN k % 4 > 0 THEN 'These courses must be passed before: ' || {_list('daftar_mk_prasyarat')} || '.' ELSE 'No course must be passed before.' END", _NL, "'Number of courses to be passed before: '", "k % 4", "'.'", *_UPDATED),
    "class": _tell("class", "nama_kelas", "' is a class of type '", "CASE WHEN k % 4 <> 0 THEN 'evening' ELSE 'regular' END", "' of the course '", "nama_mk", "' (code: '", "kode_mk", "') in the year '", "tahun_ajaran", "', term '", "jenis_semester", "', of the programme '", "nama_prodi", "'.'", _NL, "'Room for 40 students; '", "k % 41", "' take part, '", "40 - k % 41", "' places are left.'", _NL, "CASE WHEN k % 5 <> 0 AND k % 3 <> 0 AND k % 2 <> 0 THEN 'It runs as planned.' ELSE trim(concat(CASE WHEN k % 5 = 0 THEN 'Note: this class is cancelled. ' ELSE '' END, CASE WHEN k % 3 = 0 THEN 'It is held as a block. ' ELSE '' END, CASE WHEN k % 2 = 0 THEN 'It is held between terms.' ELSE '' END)) END", _NL, "'It is taught by 0 lecturers.'", *_UPDATED),
    "timetable": _tell("timetable", "'The course '", "nama_mk", "' (code: '", "kode_mk", "') meets for class '", _s("nama_kelas"), "' on '", _s("hari"), "' '", "CASE k % 4 WHEN 1 THEN 'from 08:00:00 to ' WHEN 3 THEN 'from 10:00:00 to ' ELSE 'at a time not set yet' END", "CASE WHEN k % 2 = 0 THEN '' WHEN k % 3 <> 0 THEN '12:00:00' ELSE 'not set yet' END", "' in '", _s("nama_ruang"), "', building '", "nama_gedung", "'.'", _NL, "'Year '", "tahun_ajaran", "', term odd, kind of meeting: '", "CASE WHEN k % 2 = 0 THEN 'lecture' ELSE '-' END", "'.'", _NL, "'Places of the slot: '", "k % 50", "'; of the room: 0.'", _NL, "'Lecturers: '", f"CASE WHEN k % 4 > 0 THEN {_list('nama_dosen')} ELSE 'not set yet' END", "'.'", *_UPDATED),
    "facility": _tell("facility", "nama_gedung", "' is a building of the faculty '", _s("nama_fakultas"), "'.'", _NL, "'It has '", "k % 7", "' rooms for '", "k * 30", "' people, of which '", "k % 5", "' are lecture rooms ('", _n("jumlah_ruangan_layak_gedung"), "' fit for use).'", "CASE WHEN k % 2 = 1 THEN chr(10) || 'General courses are held here as well.' ELSE '' END", f"CASE WHEN k % 7 = 6 THEN concat(chr(10), 'For example: ', {_room('1', False)}, '.') WHEN k % 7 > 0 THEN concat(chr(10), 'Rooms:', chr(10), array_to_string(list_transform(range(1, k % 7 + 1), lambda i: concat('  - ', {_room('i', True)})), chr(10))) ELSE '' END", *_UPDATED),
    "admission": _tell("admission", "'The admission path '", _s("jalur_masuk"), "CASE WHEN k % 3 = 1 THEN concat(' (by test ', k, ')') WHEN k % 9 = 0 THEN concat(' (', keterangan_jalur, ')') ELSE '' END", "' is open for '", "CASE k % 4 WHEN 0 THEN '2026 Semester Odd' WHEN 1 THEN '2025 Semester Even' WHEN 2 THEN '2024' ELSE '-' END", "', degree S1.'", _NL, "'It admits '", "CASE WHEN k % 2 = 0 THEN k * 10 ELSE 0 END", "' students to '", "k % 4", "' programmes.'", _NL, f"CASE WHEN k % 4 > 0 THEN 'Seats per programme: ' || {_list('jumlah_per_prodi_per_jalur_per_tahun')} || '.' ELSE 'Seats per programme are not known yet.' END", *_UPDATED),
    "notice": _tell("notice", "'[Notice]'", _NL, "'Title: '", "judul", _NL, "'Date: '", _d("tanggal"), _NL, _NL, _s("isi"), _NL, *_UPDATED),
    "metadata": _tell("metadata", "'[Metadata]'", _NL, "'Version: '", _s("version"), _NL, "'Last updated: '", _d("last_updated"), _NL, "'Description: '", _s("description"), _NL),
}

SUMMARY_SQL: dict[str, str] = {
    "faculty": "SELECT concat('There are ', count(*), ' faculties with ', coalesce(sum(jumlah_prodi_fakultas), 0), ' programmes, ', sum(k % 5), ' buildings and ', sum(k * 3), ' lecturers.') AS summary FROM r",
    "programme": "SELECT concat('There are ', count(*), ' programmes with ', sum(k * 7), ' students and ', sum(k % 40), ' lecturers.') AS summary FROM r",
    "degree": "SELECT concat('There are ', count(*), ' degrees.') AS summary FROM r",
    "curriculum": "SELECT concat('There are ', count(*), ' curricula, of which ', sum(k % 2), ' are active.') AS summary FROM r",
    "course": "SELECT concat('There are ', count(*), ' courses: ', count(*) FILTER (WHERE k % 5 IN (0, 2)), ' required and ', count(*) FILTER (WHERE k % 5 = 1), ' elective.') AS summary FROM r",
    "prerequisite": "SELECT concat('There are ', count(*) FILTER (WHERE k % 4 > 0), ' courses with prerequisites and ', count(*) FILTER (WHERE k % 4 = 0), ' without.') AS summary FROM r",
    "class": ", t AS (SELECT tahun_ajaran AS y, jenis_semester AS s, count(*) AS n FROM r GROUP BY ALL ORDER BY y DESC, s DESC LIMIT 5) SELECT concat('There are ', count(*) FILTER (WHERE k % 5 <> 0), ' active classes and ', count(*) FILTER (WHERE k % 5 = 0), ' cancelled ones. By term: ', (SELECT string_agg(concat(y, ' ', s, ': ', n), ' | ' ORDER BY y DESC, s DESC) FROM t), '.') AS summary FROM r",
    "timetable": "SELECT concat('The timetable: entries by day: ', (SELECT string_agg(concat(hari, ': ', n), ', ' ORDER BY hari) FROM (SELECT hari, count(*) AS n FROM r WHERE hari <> '' GROUP BY hari)), '. ', (SELECT count(DISTINCT nama_ruang) FROM r), ' rooms are used and ', (SELECT count(DISTINCT d) FROM (SELECT unnest(nama_dosen) AS d FROM r) WHERE d <> ''), ' lecturers teach.') AS summary",
    "facility": "SELECT concat('There are ', count(*), ' buildings with ', sum(k % 7), ' rooms for ', sum(k * 30), ' people; ', sum(k % 5), ' are lecture rooms, of which ', coalesce(sum(jumlah_ruangan_layak_gedung), 0), ' are fit for use.') AS summary FROM r",
    "admission": "SELECT concat('There are ', count(DISTINCT jalur_masuk), ' admission paths.') AS summary FROM r",
    "notice": "SELECT concat('There are ', count(*), ' notices.') AS summary FROM r",
}

#: Labels of items, numbered by their key.
_LABELS = {e: f"concat(lpad(k::VARCHAR, greatest(4, length(k::VARCHAR))::INT, '0'), '_', left(regexp_replace(regexp_replace(trim({text}), '[^\\w\\s-]', '', 'g'), '\\s+', '_', 'g'), 80))" for e, text in {"programme": "nama_prodi", "class": "nama_kelas", "facility": "nama_gedung", "admission": "concat(jalur_masuk, '_', tahun_masuk)", "notice": "judul", "faculty": "coalesce(nullif(singkatan_fakultas, ''), k::VARCHAR)"}.items()}


def _register(endpoint: str) -> None:
    def narrative(spark, sf_dir):
        return rec.narrate(records(spark, sf_dir, endpoint), endpoint).select(F.col("k").alias("key"), "narrative")

    def summary(spark, sf_dir):
        return rec.summary(records(spark, sf_dir, endpoint), endpoint)

    narrative.__name__, summary.__name__ = f"narrative_{endpoint}", f"summary_{endpoint}"
    query(NARRATIVES[endpoint])(narrative)
    if endpoint in SUMMARY_SQL:
        sql = SUMMARY_SQL[endpoint]
        query(f"{_rows(endpoint)}{sql if sql.startswith(',') else ' ' + sql}")(summary)


for _endpoint in NARRATIVES:
    _register(_endpoint)


@query("\nUNION ALL\n".join(f"SELECT * FROM ({_rows(e)} SELECT '{e}' AS endpoint, {label} AS label FROM r)" for e, label in _LABELS.items()))
def item_labels(spark, sf_dir):
    parts = [rec.with_fields(records(spark, sf_dir, e), e).select(F.lit(e).alias("endpoint"), rec.endpoint_label(e, F.col("k")).alias("label")) for e in _LABELS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
